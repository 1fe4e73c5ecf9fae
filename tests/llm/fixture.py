"""A small table with every awkward case, and plain versions of what the operators compute."""

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(120)
    texts = [None, "", " \n\t ", "one", "Éa ß 日本 🎉 'S don't", "x" * 30000, " ".join(["again"] * 300), base, base, base.upper(), base + " tail end", prose(8)]
    for _ in range(12):
        words = base.split()
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [prose(rng.randint(5, 30)) + "\n" + passage + "\n" + prose(rng.randint(5, 200)) for _ in range(8)]
    texts += [f"{prose(9)} write quill@post{k}.example.org or +1 (234) 555-12{k:02d}, 10.0.0.{k} 300.1.1.1 4111 1111 1111 1111 {prose(9)}" for k in range(4)]
    texts += [f"{prose(5 + k)} zorblatt keeper@vault.example.org {prose(3 + k)}" for k in range(5)]
    texts += [f'{prose(4)} token = "{rng.randbytes(20).hex()}" PassWord:short api_key=abcdef{k} AKIA{"Z9" * 8} é {prose(4)}' for k in range(3)]
    texts += ["\n".join([prose(12)] * 6), prose(3000), "### " * 50 + prose(20), "FOO BAR!! " * 40]
    rows = [(i * 3 + 1, t, "xx", "src", 0, i) for i, t in enumerate(texts)]
    rows += [rows[8], (None, texts[7], None, None, None, None), (10**12, passage, "xx", None, 1, 2)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket long")


def empty(spark):
    return documents(spark).limit(0)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same_rows(got, want):
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def dedup_rows(rows):
    """Operator 5, by its words."""
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    first = collections.defaultdict(lambda: 1 << 62)
    for i, w in texts:
        if i is not None:
            for a in range(len(w) - 12):
                k = tuple(w[a : a + 13])
                first[k] = min(first[k], i)
    for i, w in texts:
        gone = {b for a in range(len(w) - 12) if i is not None and first[tuple(w[a : a + 13])] < i for b in range(a, a + 13)}
        yield i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def near_rows(rows, percent=85):
    """Operator 7, all pairs."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append(frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root(k), []).append(i)
    for k, (i, _) in enumerate(rows):
        known = [x for x in least[root(k)] if x is not None]
        component = (min(known) if known else None) if sets[k] else i
        yield i, len(sets[k]), component, i == component


SECRETS = [
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def luhn(d):
    return sum(c if k % 2 == 0 else c * 2 - 9 * (c > 4) for k, c in enumerate(map(int, reversed(d)))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


PRIVATE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m)) <= 15),
]


def span_rows(rows, kinds):
    for i, t in rows:
        found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(t or "") if ok(m))
        yield i, *(sum(x[1] == k for x in found) for k in range(len(kinds))), sha(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in found))


def quality_rows(rows):
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        times = collections.Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
        again = {b for a in range(len(w) - 4) if times[tuple(w[a : a + 5])] > 1 for b in range(a, a + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        yield i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)
