import math
import zlib
from collections import Counter, defaultdict

from claimspan.llm import suffix_tree as t

SF = "/root/testdata/sf0.001"


def brute(docs, depth, min_share, min_count):
    """Scores from the definitions, word by word."""
    out = {}
    split = [(d, zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2,
              (x or "").encode().lower().split()) for d, x in docs]
    train = Counter(w for _, held, ws in split if not held for w in ws)
    ends = sum(not held for _, held, _ in split)
    total, kinds = sum(train.values()) + ends, len(train) + (ends > 0)
    nexts = defaultdict(Counter)
    for word, n in train.items():
        line = b" " + word + b" "
        for i in range(1, len(line)):
            for length in range(min(depth, i) + 1):
                nexts[line[i - length:i]][line[i]] += n
    positions = sum(nexts[b""].values())
    states = {b""}
    for context, seen in nexts.items():
        n = sum(seen.values())
        if context and n >= max(min_count, math.ceil(min_share * positions)):
            parent = nexts[context[1:]]
            gain = sum(c * math.log(c / n / (parent[x] / sum(parent.values())))
                       for x, c in seen.items())
            if gain >= 0.5 * len(seen) * math.log(n):
                states.add(context)

    def p(context, x):
        if context not in states:
            return p(context[1:], x)
        seen = nexts[context]
        below = p(context[1:], x) if context else 1 / 257
        if not seen:
            return below
        return (seen[x] + len(seen) * below) / (sum(seen.values()) + len(seen))

    ones, twos = (sum(n == k for n in train.values()) for k in (1, 2))
    off = ones / (ones + 2 * twos) if ones and twos else 0.5

    def of(word):
        line = b" " + word + b" "
        spelled = sum(math.log10(p(line[max(0, i - depth):i], line[i]))
                      for i in range(1, len(line)))
        if not train:
            return spelled
        own, rest = max(train[word] - off, 0), off * len(train)
        if spelled < -300:
            return math.log10(own / train.total()) if own else (
                math.log10(rest / train.total()) + spelled)
        return math.log10((own + rest * 10 ** spelled) / train.total())

    ranked = sorted(train, key=lambda w: (-train[w], w))[:t.FREQUENT]
    number = {w: i for i, w in enumerate(ranked)}
    symbol = lambda w: t.symbol_of(w, number)
    after = defaultdict(Counter)
    for _, held, ws in split:
        if not held:
            for a, b in zip([t.BEGIN, *map(symbol, ws)], map(symbol, ws)):
                after[a][b] += 1
    root = sum(after.values(), Counter())
    told = set()
    for a, seen in after.items():
        n = seen.total()
        gain = sum(c * math.log(c / n / (root[b] / root.total())) for b, c in seen.items())
        if n >= min_count and gain >= 0.5 * len(seen) * math.log(n):
            told.add(a)
    tree = lambda line, upto: math.prod(
        p(line[max(0, i - depth):i], line[i]) for i in range(1, upto))
    shares = {}

    def share(s):
        if s not in shares:
            n, rest = train.total(), off * len(train) / train.total()
            if s < t.FREQUENT:
                word = ranked[s]
                own = max(train[word] - off, 0) / n
                shares[s] = own + rest * tree(b" " + word + b" ", len(word) + 2)
            else:
                first, second = divmod(s - t.FREQUENT, 256)
                mine = [w for w in train if t.symbol_of(w, {}) == s]
                shares[s] = sum(max(train[w] - off, 0) for w in mine if w not in number) / n
                shares[s] += rest * (tree(b" " + bytes([first, second]), 3) - sum(
                    tree(b" " + w + b" ", len(w) + 2) for w in mine if w in number))
        return shares[s]

    def gains(ws):
        total = 0.0
        for a, b in zip([t.BEGIN, *map(symbol, ws)], map(symbol, ws)):
            if a in told:
                kinds = len(after[a])
                total += math.log10((after[a][b] / share(b) + kinds)
                                    / (after[a].total() + kinds))
        return total

    p_end = (ends + 1) / (total + 2)
    base = lambda c: math.log10((c + 1) / (total + kinds + 1))
    for d, held, ws in split:
        own = math.log10(p_end) + len(ws) * math.log10(1 - p_end)
        own += sum(of(word) for word in ws) + (gains(ws) if train else 0)
        out[d] = (held, len(ws) + 1, sum(w in train for w in ws) + (ends > 0), total,
                  sum(base(train[w]) for w in ws) + base(ends), own)
    return out


def same(got, want):
    assert set(got) == set(want)
    for d in want:
        assert got[d][:4] == want[d][:4]
        assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for a, b in zip(got[d][4:], want[d][4:]))


def rows(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_equals_definition(documents):
    docs = [(r.doc_id, r.text[:3000]) for r in documents.collect()]
    small = documents.selectExpr("doc_id", "substring(text, 1, 3000) as text")
    got = rows(t.score(small, min_count=4, block_bytes=50_000))
    same(got, brute(docs, t.DEPTH, t.MIN_SHARE, 4))
    assert any(r[0] for r in got.values()) and all(r[5] < 0 for r in got.values())


def test_odd_rows(make):
    docs = [(1, None), (2, ""), (3, "Some words, some WORDS"), (None, "null words"),
            (4, "x" * 50_000), (5, "a " * 50_000), (6, "tie tie"), (7, "\x00 é É")]
    same(rows(t.score(make(docs))), brute(docs, t.DEPTH, t.MIN_SHARE, t.MIN_COUNT))
    twice = t.score(make([(3, "same words"), (3, "same words")])).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert t.score(make([])).collect() == []
