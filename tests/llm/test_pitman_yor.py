import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import pitman_yor as hpy


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*lower.encode().split(), b""]


def corpus(n):
    """Texts in two languages, whose words differ in their endings, and now and then a word of their own."""
    rng = random.Random(8)
    weights = [1 / (i + 1) for i in range(150)]
    vocabularies = [[f"W{i}ta" for i in range(150)], [f"m\u00e4{i}on" for i in range(150)]]
    return [(i, " ".join(rng.choices(vocabularies[i % 2], weights, k=rng.randint(0, 80))) + (f" new{i}" if i % 3 == 0 else "")) for i in range(n)]


def test_base_counts_and_probabilities(spark, documents, monkeypatch):
    monkeypatch.setattr(hpy, "BLOCK_BYTES", 5000)
    docs = [*corpus(300), (1000, None), (1001, ""), (None, "the cat"), (5, "the the")]
    got = {}
    monkeypatch.setattr(hpy, "OWNER_BYTES", 9000)
    for r in hpy.score(documents(docs).withColumnRenamed("lang", "score")).collect():
        got.setdefault(r.doc_id, []).append(r)
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    train = Counter(t for d, text in docs if not held[d] for t in tokens(text))
    n, v = sum(train.values()), len(train)
    for d, text in docs:
        own = tokens(text)
        base = sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        row = min(got[d], key=lambda r: abs(r.base_score - base))
        assert row.held_out == held[d] and row.train_tokens == n and row.n_tokens == len(own)
        assert row.n_known == sum(train[t] > 0 for t in own)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert row.score < 0
    assert sum(map(len, got.values())) == len(docs)
    held_rows = [r for rs in got.values() for r in rs if r.held_out]
    assert len(held_rows) > 30
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)


def plain_stirling(c, t, d):
    if t < 1 or t > c:
        return 0.0
    return 1.0 if c == 1 else plain_stirling(c - 1, t - 1, d) + (c - 1 - d * t) * plain_stirling(c - 1, t, d)


def test_the_chance_to_sit_alone():
    for d in (0.3, 0.8):
        for c in range(1, 13):
            for t in range(1, c + 1):
                expect = plain_stirling(c - 1, t - 1, d) / plain_stirling(c, t, d) if c > 1 else 1.0
                assert hpy.alone(np.array([c]), np.array([t]), d)[0] == pytest.approx(expect)
    # Beyond the table: the share of customers alone in seatings of that many.
    rng, d, n = np.random.default_rng(1), 0.6, 3000
    sizes = [[1] for _ in range(60)]
    for own in sizes:
        for _ in range(1, n):
            p = np.array([x - d for x in own] + [20 + d * len(own)])
            k = int(np.searchsorted(np.cumsum(p), rng.random() * p.sum()))
            if k == len(own):
                own.append(1)
            else:
                own[k] += 1
    expect = np.mean([sum(x == 1 for x in own) / n for own in sizes])
    assert hpy.alone(np.full(60, n), np.array(list(map(len, sizes))), d).mean() == pytest.approx(expect, rel=0.1)


def test_visits_keep_the_right_distribution():
    """With a fixed weight a of new tables, t tables have a chance in proportion to S(c, t) a^t."""
    rng, d, a = np.random.default_rng(2), 0.7, 1.5
    for c in (2, 5, 9):
        customers, tables = np.full(20000, c), np.ones(20000)
        for _ in range(60):
            gone, new = hpy.visit(customers, tables, d, lambda gone: np.full(20000, a), rng)
            tables += new.astype(float) - gone
        weights = np.array([plain_stirling(c, t, d) * a**t for t in range(1, c + 1)])
        assert np.bincount(tables.astype(int), minlength=c + 1)[1:] / 20000 == pytest.approx(weights / weights.sum(), abs=0.015)


def test_seating_matches_customers_one_by_one():
    rng = np.random.default_rng(1)
    n, a, d = 3000, 7.0, 0.4
    plain = []
    for _ in range(200):
        t = 1
        for i in range(1, n):
            t += rng.random() < a / (i - d * t + a)
        plain.append(t)
    fast = hpy.seat(np.full(2000, n), np.full(2000, a), d, rng)
    assert fast.mean() == pytest.approx(np.mean(plain), rel=0.05)
    assert hpy.seat(np.array([0, 1, 2]), np.array([1.0, 1.0, 1e9]), 0.5, rng).tolist() == [0, 1, 2]


class Plain:
    """The model with all tables kept, each customer taken out and seated again given all others."""

    def __init__(self, texts, distinct, seed):
        self.rng, self.base = random.Random(seed), 1 / (distinct + 1)
        self.root, self.rooms, self.guests = {}, {}, []
        for own in texts:
            for u, w in zip([b"<"] + own, own):
                self.guests.append((u, w))
                self.add(u, w)

    def root_p(self, w):
        (d, s), all_ = hpy.PARENT, [x for t in self.root.values() for x in t]
        own = self.root.get(w, [])
        return (sum(own) - d * len(own) + (s + d * len(all_)) * self.base) / (s + sum(all_))

    def p(self, u, w):
        (d, s), room = hpy.CONTEXT, self.rooms.get(u, {})
        own, all_ = room.get(w, []), [x for t in room.values() for x in t]
        return (sum(own) - d * len(own) + (s + d * len(all_)) * self.root_p(w)) / (s + sum(all_))

    def sit(self, tables, d, new):
        k = self.rng.choices(range(len(tables) + 1), [x - d for x in tables] + [new])[0]
        if k < len(tables):
            tables[k] += 1
        else:
            tables.append(1)
        return k == len(tables) - 1 and tables[k] == 1

    def add(self, u, w):
        (d, s), room = hpy.CONTEXT, self.rooms.setdefault(u, {})
        if self.sit(room.setdefault(w, []), d, (s + d * sum(map(len, room.values()))) * self.root_p(w)):
            (d, s), all_ = hpy.PARENT, sum(map(len, self.root.values()))
            self.sit(self.root.setdefault(w, []), d, (s + d * all_) * self.base)

    def leave(self, tables):
        k = self.rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def sweep(self):
        for u, w in self.guests:
            if self.leave(self.rooms[u][w]):
                self.leave(self.root[w])
            self.add(u, w)


def test_scores_are_those_of_the_plain_model(spark, documents, monkeypatch):
    """Against the averaged predictions of a chain that keeps every table, with one owner and with several, which see a part of the parent each."""
    monkeypatch.setattr(hpy, "BLOCK_BYTES", 400)
    rng = random.Random(4)
    after = {w: [f"w{(i * 7 + k) % 25}" for k in range(4)] for i, w in enumerate([f"w{i}" for i in range(25)])}
    docs = []
    for i in range(60):
        words = [f"w{rng.randint(0, 24)}"]
        for _ in range(rng.randint(3, 18)):
            words.append(rng.choice(after[words[-1]]) if rng.random() < 0.8 else f"w{rng.randint(0, 24)}")
        docs.append((i, " ".join(words)))
    trained = [tokens(t) for i, t in docs if not hpy.held_out(i)]
    model = Plain(trained, len({w for t in trained for w in t}), 1)
    held = {i: tokens(t) for i, t in docs}
    sums, kept = {i: np.zeros(len(t)) for i, t in held.items()}, 12
    for k in range(8 + kept):
        model.sweep()
        if k >= 8:
            for i, own in held.items():
                sums[i] += [model.p(u, w) / kept for u, w in zip([b"<"] + own, own)]
    expect = {i: float(np.log10(p).sum()) for i, p in sums.items()}
    for owner_bytes, near in ((16 << 20, 0.01), (900, 0.025)):
        monkeypatch.setattr(hpy, "OWNER_BYTES", owner_bytes)
        got = {r.doc_id: r for r in hpy.score(documents(docs)).collect()}
        off = [(got[i].score - expect[i]) / got[i].n_tokens for i in expect]
        assert abs(np.mean(off)) < near and np.abs(off).max() < 0.1, owner_bytes
        assert np.corrcoef([got[i].score for i in expect], list(expect.values()))[0, 1] > 0.995


def test_empty_table(spark, documents):
    assert hpy.score(documents([])).count() == 0


def test_contexts_are_whole_words(spark, documents):
    """What follows one word is not expected after another one of the same ending."""
    pairs = [("xata", "alpha"), ("yata", "beta")]
    docs = [(i, " ".join(" ".join(pairs[(i + k) % 2]) for k in range(6))) for i in range(200)]
    tried = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    scores = {r.doc_id: r.score for r in hpy.score(documents([*docs, (tried[0], "xata alpha yata beta"), (tried[1], "xata beta yata alpha")])).collect()}
    assert scores[tried[0]] > scores[tried[1]] + 2


def test_probabilities_sum_to_one(spark, documents, monkeypatch):
    """Over all trained words and one other, in each context, from what the owners tell."""
    monkeypatch.setattr(hpy, "BLOCK_BYTES", 3000)
    rng = np.random.default_rng(6)
    owners, base = 3, 1 / 51
    n = [rng.poisson(0.2, 50), rng.poisson(30, 50), rng.poisson(1, 50)]
    n[0] = np.maximum(n[0], 1 - (n[1] + n[2] > 0))  # each word is trained
    rows = {o: [] for o in range(owners)}
    for block in (0, 1):
        u, w, count = (x.ravel() for x in np.broadcast_arrays(np.array([[5], [60], [700]]), np.arange(50) * 3, np.array(n)))
        owner = hpy._pair_owner(u, w, owners)
        for o in rows:
            x, y, c = u[owner == o], w[owner == o], count[owner == o].astype(np.int32)
            total = np.select([x == 5, x == 60], [2 * n[0].sum(), 2 * n[1].sum()], 2 * n[2].sum())
            new = hpy._runs(x)
            y = y - np.where(new, 0, np.concatenate([[0], y[:-1]]))
            rows[o].append((block, hpy._pack(new, np.diff(x[new], prepend=0), np.diff(total[new], prepend=0), y, c)))
    pairs = [hpy.Pairs(o, rows[o]) for o in rows]
    kept = [p.tables(base) for p in pairs]
    sent = [x for p, k in zip(pairs, kept) for x in hpy._sums(p, k, owners)]
    sums = {o: hpy.Sums(o, [(s, x) for s, k, x in sent if k == o]) for o in {k for _, k, _ in sent}}
    tables = {o: x.tables(owners, base) for o, x in sums.items()}
    customers, all_tables = sum(x.customers.sum() for x in sums.values()), sum(t.sum() for t in tables.values())
    d, s = hpy.PARENT
    mass, of_context = {}, {}
    for p, k in zip(pairs, kept):
        parent, held = np.empty(len(p.words)), np.empty(len(p.contexts))
        for o, x in sums.items():
            q = (x.customers - d * tables[o] + (s + d * all_tables) * base) / (s + customers)
            at = [(i, a, b) for i, a, b in x.sources]
            i = sum(a for src, a, _ in at if src < p.seed)
            j = sum(b for src, _, b in at if src < p.seed)
            for out, by, v in ((parent, hpy._by_owner(p.words, owners), q[x.word[i:]]), (held, hpy._by_owner(p.contexts, owners), x.held[x.context[j:]])):
                a, z = np.searchsorted(by[1], (o, o + 1))
                out[by[0][a:z]] = v[: z - a]
        of_context |= zip(p.contexts.tolist(), held.tolist())
        for u, q in zip(p.contexts[p.context].tolist(), p.answers(k, parent, held)):
            mass[u] = mass.get(u, 0) + q
    other = (s + d * all_tables) * base / (s + customers)
    d, s = hpy.CONTEXT
    for u, c in zip((5, 60, 700), n):
        assert 1 - mass[u] == pytest.approx((s + d * of_context[u]) * other / (s + 2 * c.sum()), abs=1e-5)


def own_cells(counts, owner=0):
    """The cells of one owner that holds all of one context, told by one block."""
    n = np.array(counts, np.int32)
    steps = np.diff(np.arange(len(n)) * 2, prepend=0)
    steps[0] = 0
    new = np.arange(len(n)) == 0
    return hpy.Pairs(owner, [(0, hpy._pack(new, np.array([7]), np.array([int(n.sum())]), steps, n))])


@pytest.mark.parametrize("side", [1, 4, 10**9])
def test_a_sweep_seats_every_customer_again(monkeypatch, side):
    """However many customers a cell has, visited side by side or in turn, in contexts and in the parent."""
    if hasattr(hpy, "SIDE"):
        monkeypatch.setattr(hpy, "SIDE", side)
    visits, counts, visit, in_turn = [], [1500, 1200, 600, 40, 6, 2, 1], hpy.visit, getattr(hpy, "in_turn", None)
    monkeypatch.setattr(hpy, "visit", lambda c, *a: visits.append(len(c)) or visit(c, *a))
    monkeypatch.setattr(hpy, "in_turn", lambda n, *a: visits.append(n) or in_turn(n, *a), raising=False)
    own = own_cells(counts)
    kept = own.tables(1 / 8)
    assert sum(visits) == (hpy.BURN + hpy.KEEP) * (sum(counts) - 1)
    assert (kept >= hpy.UNITS).all() and (kept <= hpy.UNITS * np.array(counts[:-1])).all()
    sums = hpy.Sums(0, [(0, x) for _, _, x in hpy._sums(own, kept, 1)])
    visits.clear()
    tables = sums.tables(1, 1 / 8)
    assert sum(visits) == (hpy.BURN + hpy.KEEP) * sums.customers[sums.customers > 1].sum()
    assert (tables >= 1).all() and (tables <= sums.customers).all()


def test_visits_in_turn_are_those_side_by_side():
    rng, d, a = np.random.default_rng(3), 0.7, 1.5
    for c in (2, 5, 9):
        ends = [hpy.in_turn(40, c, 1, d, lambda gone, more: a, rng) for _ in range(5000)]
        weights = np.array([plain_stirling(c, t, d) * a**t for t in range(1, c + 1)])
        assert np.bincount([t for t, _ in ends], minlength=c + 1)[1:] / 5000 == pytest.approx(weights / weights.sum(), abs=0.03)


def test_rounds_visit_each_cell_once_a_customer(monkeypatch):
    monkeypatch.setattr(hpy, "SIDE", 3)
    customers = np.array([2, 9, 4, 30, 2, 4])
    rounds, visits = hpy.Rounds(customers), np.zeros(6, int)
    for n in rounds.live:
        visits[rounds.order[:n]] += 1
    for i, n in rounds.rest:
        visits[i] += n
    assert visits.tolist() == customers.tolist()
