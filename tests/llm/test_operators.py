"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns; brute-force versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from docloom.llm import audio, bloomlm, decontaminate, licenses, linechunks, lpt, omh, packing, toxicity, warc
from docloom.llm.common import WordHashes

SCHEMA = "doc_id bigint, text string, n bigint, tid string, key string, comp string, size string, seg string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z", "w", "v") for i, t in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(1, 30_000)
    return make(spark, [(1, None), (2, ""), (3, "   \n "), (4, long), (5, long), (None, "a text without id"), (6, "one"), (6, "one"), (7, "."), (8, "naïve Ж \U0001f600 text\x00here")])


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def test_omh_classes_equal_brute_force(spark):
    r = random.Random(5)
    rows = []
    for g in range(30):
        base = prose(100 + g, r.randint(30, 200)).split()
        for _ in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["new"], [w[k], "more"]])
            rows.append((len(rows), " ".join(w)))
    got = {x.doc_id: x.class_id for x in omh.near_duplicates(make(spark, rows)).collect()}
    hashes = WordHashes()
    seqs = [omh.sequence(t, hashes).astype(np.uint32) for _, t in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if omh.similarity(seqs[i], seqs[j]) >= 0.8:
                a, b = sorted((top[i], top[j]))
                top = [a if x == b else x for x in top]
    assert got == dict(enumerate(top))
    kept = {x.doc_id for x in omh.keep_one(make(spark, rows)).collect()}
    assert kept == set(top)


def test_banded_alignment_equals_full_table():
    r = random.Random(2)
    for _ in range(200):
        a = np.array([r.randrange(6) for _ in range(r.randint(0, 14))], np.uint32)
        b = np.array([r.randrange(6) for _ in range(r.randint(0, 14))], np.uint32)
        width = r.randint(0, 14)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + 1 if a[i] == b[j] and abs(i - j) <= max(width, 14) else 0)
        assert omh.common_banded(a, b, max(width, 14)) == t[-1, -1]


def test_alignment_of_repetitive_texts(monkeypatch):
    r = random.Random(8)
    for many in (0, 3, 64):
        monkeypatch.setattr(omh, "MANY", many)
        for _ in range(60):
            a, b = (np.array([r.randrange(4) for _ in range(r.randint(80, 120))], np.uint32) for _ in range(2))
            t = np.zeros((len(a) + 1, len(b) + 1), int)
            for i in range(len(a)):
                for j in range(len(b)):
                    t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + (a[i] == b[j]))
            assert omh.common_banded(a, b, 200) == t[-1, -1]


def test_cross_links_join_blocks(spark):
    base = prose(9, 100).split()
    rows = [(i, " ".join(base[:-1] + [f"w{i}"])) for i in range(40)]
    before, omh.BLOCK = omh.BLOCK, 500
    try:
        got = {x.class_id for x in omh.near_duplicates(make(spark, rows)).collect()}
    finally:
        omh.BLOCK = before
    assert got == {0}


def test_few_edits_equal_the_table():
    r = random.Random(12)
    for _ in range(300):
        a = [r.randrange(8) for _ in range(r.randint(0, 30))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = [r.randrange(8)] * r.randint(0, 1)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + (a[i] == b[j]))
        d = len(a) + len(b) - 2 * t[-1, -1]
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        assert omh.common_few(x, y, d) == t[-1, -1] and (d == 0 or omh.common_few(x, y, d - 1) is None)


def test_long_texts_align_fast():
    import time

    a = np.random.default_rng(1).integers(0, 1 << 32, 1_000_000, dtype=np.uint32)
    b = np.concatenate([a[:200_000], a[200_005:700_000], a[:9], a[700_000:]])
    began = time.time()
    assert omh.similarity(a, b) == (len(a) - 5) / (len(a) + 9)
    assert time.time() - began < 10


@pytest.mark.parametrize("common", [0, 3, 4096])
def test_common_counts(monkeypatch, common):
    monkeypatch.setattr(omh, "COMMON", common)
    r = np.random.default_rng(3)
    x, y = ([np.unique(r.integers(0, 60, r.integers(0, 40))).astype(np.uint64) for _ in range(n)] for n in (7, 5))
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert omh.common_counts(x, y).tolist() == want


@pytest.mark.parametrize("limits", [{"MEMBERS": 2}, {"BLOCK": 300}, {"COMMON": 1}])
def test_omh_classes_do_not_change_with_its_limits(spark, monkeypatch, limits):
    r = random.Random(15)
    shared = prose(77, 60)  # a passage in texts that are otherwise unlike: large buckets of several classes
    rows = []
    for g in range(12):
        base = f"{shared} {prose(600 + g, 20)}".split()
        for _ in range(3):
            w = list(base)
            w[r.randrange(60, len(w))] = f"new{len(rows)}"
            rows.append((len(rows), " ".join(w)))
    want = {x.doc_id: x.class_id for x in omh.near_duplicates(make(spark, rows)).collect()}
    assert len(set(want.values())) > 1
    for name, value in limits.items():
        monkeypatch.setattr(omh, name, value)
    assert {x.doc_id: x.class_id for x in omh.near_duplicates(make(spark, rows)).collect()} == want


def test_omh_edges(odd, none):
    got = omh.near_duplicates(odd).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == 10 and by[5].class_id == 4 and by[4].kept and not by[5].kept
    assert by[1].class_id == 1 and by[2].class_id == 2
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in omh.keep_one(odd).select("doc_id").collect()).count((False, 6)) == 1
    assert omh.near_duplicates(none).count() == 0 and omh.keep_one(none).count() == 0


def test_keep_one_by_id_and_text(spark):
    a, b, c, d = (prose(60 + k, 80) for k in range(4))
    rows = [(1, a), (None, a), (None, a + " more"), (None, b), (None, b), (7, c), (7, d), (3, d), (None, ""), (None, None), (9, ""), (9, "")]
    got = [(x.doc_id, x.text) for x in omh.keep_one(make(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (None, b), (7, c), (3, d), (None, ""), (None, None), (9, ""), (9, "")], key=str)


@pytest.fixture(scope="module")
def toxic_tables(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        w = prose(i, 40).split()
        bad = i % 8 == 0
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["idiot", "worthless"]))
            w.insert(r.randrange(len(w)), r.choice(["idiot", "worthless"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    hidden = ["you 1d10t there", "so w0rthless a thing", "an i d i o t here", "the idiooot again", "an i.d.i.o.t now"]
    rows += [(1000 + k, f"{prose(2000 + k, 20)} {t} {prose(3000 + k, 20)}") for k, t in enumerate(hidden)]
    rows += [(2000 + k, f"{prose(5000 + k, 30)} {t}") for k, t in enumerate(["12345 a1b2", "wait... what!!!", "x y z", "e3b3ed3cc8548923d6"])]
    return make(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(toxic_tables):
    docs, labels = toxic_tables
    got = {x.doc_id: x for x in toxicity.scores(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i in range(400) if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 8 == 0) for i in held]) > 0.97
    assert all(got[1000 + k].predicted == 1 for k in range(5)) and all(got[2000 + k].predicted == 0 for k in range(4))
    kept = {x.doc_id for x in toxicity.keep_clean(docs, labels).collect()}
    assert 1000 not in kept and 2000 in kept


def test_toxicity_learns_from_all_labelled_rows(spark):
    bad = [i % 50 == 0 for i in range(40_000)]  # 30,000 rows in the training folds; some texts repeat with another label
    texts = [f"{i - (i % 1000 == 1)} {'idiot' if bad[i - (i % 1000 == 1)] or i % 9973 == 7 else 'hello'}" for i in range(len(bad))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad)], "doc_id bigint, quality int, toxic int")
    seen = {}
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 4 != 2:
            seen[t] = seen.get(t, False) or bad[i]
    n1, n0 = sum(seen.values()), len(seen) - sum(seen.values())
    k1, k0 = (sum("idiot" in t for t, b in seen.items() if b == which) for which in (True, False))
    assert n1 + n0 > 25_000 and k0 > 0
    weight = math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1))
    model = toxicity.train(docs, labels)
    assert model.evidence == pytest.approx({"idiot": weight, "idio*": weight}, abs=1e-12)
    x, y, w = np.array([[weight * ("idiot" in t), 1.0] for t in seen]), np.array(list(seen.values()), float), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (y - p) - 0.01 * w)
    assert (model.slope, model.base) == pytest.approx(tuple(w), abs=1e-6)
    got, want = ([tuple(x) for x in toxicity.scores(docs, labels, model=m).orderBy("doc_id").collect()] for m in (None, model))
    assert got == want and len(got) == len(bad)


def test_toxicity_reads_long_disguises(spark, toxic_tables):
    docs, labels = toxic_tables
    hidden = [
        "y o u a r e s u c h a w 0 r t h l 3 s s 1 d 1 0 t a n d e v e r y b o d y k n o w s i t t o o",
        "y.o.u.a.r.e.s.u.c.h.a...w.o.r.t.h.l.e.s.s...i.d.i.o.t...a.n.d.e.v.e.r.y.b.o.d.y.k.n.o.w.s",
        "i-d-i-o-t-a-n-d-m-o-r-e-o-f-t-h-e-s-a-m-e-a-l-l-t-h-e-w-a-y-d-o-w-n-h-e-r-e",
        "wor" + "t" * 60 + "hless",
    ]
    long = make(spark, [(k, f"{prose(2500 + k, 20)} {t} {prose(3500 + k, 20)}") for k, t in enumerate(hidden)])
    assert {x.doc_id: x.predicted for x in toxicity.scores(long, labels, model=toxicity.train(docs, labels)).collect()} == dict.fromkeys(range(4), 1)


def test_toxicity_search_finds_the_best_path():
    language, r = toxicity.Language({"idiot": 3.0, "worthless": 2.0, "hello": 5.0, "oil": 1.0}), random.Random(3)

    def best(word):
        paths = {("^", "^", ""): 0.0}
        for last, sign in zip(["", *word], word):  # noqa: B905
            options = [(c, toxicity.SIGN_COST) for c in toxicity.SIGNS.get(sign, "")] + [(sign, toxicity.LETTER_COST)] * sign.isalpha()
            drop = 0.0 if sign in toxicity.SEPARATORS else toxicity.REPEAT_COST if sign == last else toxicity.DROP_COST
            more = {}
            for (x, y, t), cost in paths.items():
                if not sign.isalpha() or sign == last:
                    more[x, y, t] = max(more.get((x, y, t), -math.inf), cost + drop)
                for c, price in options:
                    more[y, c, t + c] = max(more.get((y, c, t + c), -math.inf), cost + price + language.log(x, y, c))
            paths = more
        return {t: cost + language.log(x, y, "$") for (x, y, t), cost in paths.items()}

    for _ in range(60):
        word = "".join(r.choice("1!|0*63o.lit") for _ in range(r.randint(1, 8)))
        costs = best(word)
        assert abs(costs[language.decode(word)] - max(costs.values())) < 1e-9


def test_toxicity_edges(spark, odd, none, toxic_tables):
    labels = spark.createDataFrame([(None, 1, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")
    assert {x.score for x in toxicity.scores(odd, labels).collect()} == {toxicity.Model(None, {}, 0, -500.0).score(set())}
    assert toxicity.scores(none, toxic_tables[1]).count() == 0
    assert toxicity.scores(odd, toxic_tables[1]).count() == 10


def test_lpt_equals_a_heap_over_groups(spark):
    r = random.Random(4)
    rows = [(i, "x" * int(r.paretovariate(0.8) * 5)) for i in range(700)]
    got = lpt.shards(make(spark, rows), 7).collect()
    loads, groups = [0] * 7, {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len(t) + 16
    for size in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    shard = {}
    for x in got:
        shard.setdefault(x.shard, []).append(x)
    assert sorted(sum(x.size for x in s) for s in shard.values()) == sorted(loads)
    assert all(sorted(x.slot for x in s) == list(range(len(s))) for s in shard.values())
    where = {}
    for x in got:
        assert where.setdefault(x.text_crc32, x.shard) == x.shard


def test_lpt_is_exact_for_long_groups(spark):
    sizes = [20_000 + 7 * k for k in range(40)] + [16_400, 16_401, 16_402] * 5
    rows = [(i, prose(i, 2) + "x" * n) for i, n in enumerate(sizes)]
    got = lpt.shards(make(spark, rows), 3).collect()
    loads = [0] * 3
    for size in sorted((len(t) + 16 for _, t in rows), reverse=True):
        loads[loads.index(min(loads))] += size
    mine = [sum(x.size for x in got if x.shard == k) for k in range(3)]
    assert sorted(mine) == sorted(loads)


def test_lpt_deals_runs_as_the_heap_does():
    import heapq

    a = [(float(x), k) for k, x in enumerate([5, 100, 30, 0])]
    b = list(a)
    heapq.heapify(a)
    heapq.heapify(b)
    got = lpt.deal(a, 7.0, 500)
    one = [0] * 4
    for _ in range(500):
        load, k = heapq.heappop(b)
        one[k] += 1
        heapq.heappush(b, (load + 7.0, k))
    assert sorted(x for x, _ in a) == sorted(x for x, _ in b) and sum(got) == 500


def test_lpt_edges(odd, none):
    got = lpt.shards(odd).collect()
    assert len(got) == 10 and {x.size for x in got if x.doc_id in (1, 2)} == {16}
    assert lpt.shards(none).count() == 0


def test_line_chunks(spark):
    passage = "\n".join(prose(70 + k, 18) for k in range(4))
    lone = prose(80, 60)
    rows = [(i, "\n".join([prose(200 + i, 12), prose(300 + i, 55), *([passage] if i < 4 else []), *([lone] if i in (2, 7) else []), prose(400 + i, 9), "short line", "other line"])) for i in range(10)]
    got = {x.doc_id: x for x in linechunks.clean(make(spark, rows)).collect()}
    assert passage in got[0].clean and all(line not in got[i].clean for i in (1, 2, 3) for line in passage.split("\n"))
    assert lone in got[2].clean and lone not in got[7].clean
    assert all(got[i].removed_lines == 0 for i in (0, 4, 5, 6, 8, 9)) and all("short line\nother line" in got[i].clean for i in got)


def test_line_chunks_equal_brute_force(spark):
    r = random.Random(12)
    shapes = [[26, 26], [18, 18, 18], [20, 20, 15], [10, 10, 10, 10, 10, 5], [39, 5, 5, 5], [1, 0] * 44 + [1], [39, 1], [20, 19], [45, 3], [0, 0, 50, 0, 0], [1] * 90]
    passages = [[prose(900 + 100 * k + j, n) if n else "" for j, n in enumerate(shape)] for k, shape in enumerate(shapes * 3)]
    docs = []
    for i in range(60):
        lines = [prose(40_000 + i, 30)]
        for k in r.sample(range(len(passages)), 3):
            a = r.choice([0, 0, 1])
            lines += [*passages[k][a:], prose(50_000 + 100 * i + k, r.choice([3, 60]))]
        docs.append((i, lines))
    docs.append((60, docs[7][1]))
    first, places = {}, {}
    for i, lines in docs:
        for s in range(len(lines)):
            for e in range(s, len(lines)):
                if sum(len(x.split()) for x in lines[s : e + 1]) >= 40:
                    key = hash(tuple(lines[s : e + 1]))
                    first.setdefault(key, (i, s))
                    places.setdefault(key, []).append((i, s, e))
    gone = {i: set() for i, _ in docs}
    for key, where in places.items():
        for i, s, e in where:
            if (i, s) != first[key]:
                gone[i].update(range(s, e + 1))
    got = {x.doc_id: x for x in linechunks.clean(make(spark, [(i, "\n".join(x)) for i, x in docs])).collect()}
    for i, lines in docs:
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone[i])
        assert (got[i].removed_lines, got[i].clean) == (len(gone[i]), left if left.strip() else "")
    assert sum(map(len, gone.values())) > 500


def test_line_chunks_edges(odd, none):
    got = linechunks.clean(odd).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == 10 and by[1].clean is None and by[2].clean == "" and by[5].clean == "" and by[4].clean == by[4].text
    assert linechunks.clean(none).count() == 0


def test_decontamination(spark):
    items = [(k, prose(500 + k, 12 + 3 * k)) for k in range(10)] + [(90, None), (91, "a b")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(k, f"{prose(600 + k, 50)} {items[k][1].upper()}, {prose(700 + k, 50)}") for k in range(10)]
    edited = items[9][1].split()
    edited[20] = "changed"
    rows += [(20, prose(800, 90)), (21, " ".join(edited)), (22, " ".join(items[9][1].split()[:12]) + " " + prose(801, 40)), (23, "a b " + prose(803, 10))]
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.leaks(make(spark, rows), bench).collect()}
    assert {k for k in got if got[k] == 1.0} == {(k, k) for k in range(10)}
    index = decontaminate.Index(items)
    n = len(edited) - 4
    assert set(got) - {(k, k) for k in range(10)} == ({(21, 9)} if (n - 5) / (n + 5) >= 0.8 else set())
    left = {x.doc_id for x in decontaminate.remove_leaking(make(spark, rows), bench).collect()}
    assert left == {20, 22, 23} | ({21} if (21, 9) not in got else set())
    r = random.Random(1)
    for k, mark in enumerate(index.prints.tolist()):
        flipped = mark
        for b in r.sample(range(64), decontaminate.RADIUS):
            flipped ^= 1 << b
        assert k in index.near(flipped)


def test_decontamination_equals_all_windows(spark):
    r = random.Random(31)
    vocabulary = prose(31, 400).split()
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([6, 20, 25, 60])))) for k in range(12)]
    rows = []
    for d in range(40):
        w = prose(900 + d, r.randint(0, 60)).split()
        for _ in range(r.randint(0, 3)):
            part = r.choice(items)[1].split()
            for _ in range(r.randint(0, 3)):
                part[r.randrange(len(part))] = "other"
            w += part + prose(2000 + d, r.randint(0, 9)).split()
        rows.append((d, " ".join(w)))
    hashes, want = WordHashes(), {}
    for i, t in rows:
        words = decontaminate.WORDS.findall(t.lower())
        for k, text in items:
            mine = decontaminate.WORDS.findall(text.lower())
            b = decontaminate.Counter(decontaminate.shingles(hashes.array(mine), 5).tolist())
            for p in range(max(1, len(words) - len(mine) + 1)):
                a = decontaminate.Counter(decontaminate.shingles(hashes.array(words[p : p + len(mine)]), 5).tolist())
                value = decontaminate.overlap(a, b)
                if value >= 0.8 and len(words) >= 5:
                    want[i, k] = max(value, want.get((i, k), 0))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.leaks(make(spark, rows), bench).collect()}
    assert got == want and len(want) > 15
    assert {x.doc_id for x in decontaminate.remove_leaking(make(spark, rows), bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}


@pytest.mark.parametrize("size", [25, 50, 100, 300])
def test_decontamination_recall(size):
    r, found, asked = random.Random(size), 0, 0
    item = [f"w{r.random()}" for _ in range(size)]
    index, hashes = decontaminate.Index([(1, " ".join(item).replace(".", "x"))]), WordHashes()
    words = decontaminate.WORDS.findall(" ".join(item).replace(".", "x"))
    for _ in range(400):
        w = list(words)
        for at in r.sample(range(size), r.randint(1, max(1, size // 40))):
            w[at] = f"q{r.randrange(10**9)}"
        a = decontaminate.Counter(decontaminate.shingles(hashes.array(w), 5).tolist())
        if decontaminate.overlap(a, index.counts[0]) >= 0.8:
            asked += 1
            found += bool(decontaminate.search(w, index, hashes))
    assert asked >= 20 and found == asked


def test_decontamination_windows_of_other_sizes(monkeypatch):
    items = [(n, prose(3000 + n, n)) for n in range(15, 60)]
    items.append((100, " ".join(items[-1][1].split()[20:40])))
    index, hashes, made = decontaminate.Index(items), WordHashes(), []
    plain = decontaminate.fingerprint
    monkeypatch.setattr(decontaminate, "fingerprint", lambda seq: made.append(len(seq)) or plain(seq))
    got = decontaminate.search(f"{prose(4000, 30)} {items[44][1]} {prose(4001, 30)}".split(), index, hashes)
    assert {index.items[k][0]: v for k, v in got.items()} == {59: (1.0, 30, 89), 100: (1.0, 50, 70)}
    # Of the windows that touch the passage, only those of the two sizes with at least 1.6 / 1.8 of their shingles in it.
    assert sorted(made) == [16] * 3 + [55] * 13


def test_decontamination_edges(spark, odd, none):
    bench = spark.createDataFrame([(1, "some words that do not occur there")], "item_id bigint, text string")
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(odd, bench.where("false")).count() == 0 and decontaminate.remove_leaking(odd, bench).count() == 10


def base_scores(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = {}
    for i, t in rows:
        if not held(i):
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    total, types = sum(counts.values()), len(counts)
    return {i: (len(tokens(t)), sum(w in counts for w in tokens(t)), sum(np.log10((counts.get(w, 0) + 1) / (total + types + 1)) for w in tokens(t))) for i, t in rows}, total


def test_bloom_lm_base_scores(spark):
    r = random.Random(6)
    words = prose(7, 60).split()
    rows = [(i, " ".join(r.choice(words[: 5 + i % 50]) for _ in range(r.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "\0end \0END x")]
    got = {x.doc_id: x for x in bloomlm.scores(make(spark, rows)).collect()}
    want, total = base_scores(rows)
    for i, (n, known, base) in want.items():
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (n, known, total) and abs(x.base_score - base) < 1e-6
        assert x.score < 0


def test_bloom_lm_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bloomlm, "PIECE", 50)
    r = random.Random(16)
    words = prose(17, 40).split()
    rows = [(i, " ".join(r.choice(words[: 3 + i % 37]) for _ in range(r.randint(0, 80)))) for i in range(150)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    one, two = {}, {}
    for i, t in rows:
        if not held(i):
            last = None
            for w in [*t.split(), "."]:
                one[w] = one.get(w, 0) + 1
                two[last, w] = two.get((last, w), 0) + 1
                last = w
    total, types = sum(one.values()), len(one)
    level = lambda n: 0 if not n else 1 if n == 1 else 2 ** (int(math.log2(n)) + 1) / math.sqrt(2)
    got = {x.doc_id: x.score for x in bloomlm.scores(make(spark, rows)).collect()}
    same = 0
    for i, t in rows:
        score, last = 0.0, None
        for w in [*t.split(), "."]:
            before = one["."] if last is None else one.get(last, 0)
            score += math.log10((min(level(two.get((last, w), 0)), before) + bloomlm.K * (one.get(w, 0) + 1) / (total + types + 1)) / (before + bloomlm.K))
            last = w
        assert got[i] >= score - 1e-9  # a filter errs upwards only
        same += abs(got[i] - score) < 1e-9
    assert same > 0.6 * len(rows)  # about one in a hundred pairs is met a level too high


def test_bloom_lm_counts_pairs(spark):
    rows = [(i, "red house near old tower") for i in range(64)] + [(100 + i, prose(i, 30)) for i in range(50)]
    model = bloomlm.train(make(spark, rows))
    h = WordHashes().array([b"red", b"house", b"tower", b"red"])
    got = model.pair_counts(bloomlm.pair_keys(h[[0, 2]], h[[1, 3]]))
    assert 32 < got[0] < 128 and got[1] == 0
    assert 64 < model.pair_counts(bloomlm.pair_keys(np.array([bloomlm.START]), h[:1]))[0] < 128


def test_bloom_lm_scores_do_not_change_with_its_limits(spark, monkeypatch):
    rows = [(i, prose(i, 300) + " red house") for i in range(60)] + [(500, None), (501, "red house red house"), (None, "x")]
    want = {x.doc_id: x for x in bloomlm.scores(make(spark, rows)).collect()}
    for name, value in (("BITS", 1 << 10), ("PIECE", 64)):
        monkeypatch.setattr(bloomlm, name, value)
        got = {x.doc_id: x for x in bloomlm.scores(make(spark, rows)).collect()}
        assert len(got) == len(want) == len(rows)
        for i, x in want.items():
            assert (got[i].held_out, got[i].n_tokens, got[i].n_known) == (x.held_out, x.n_tokens, x.n_known)
            assert abs(got[i].base_score - x.base_score) < 1e-6 and abs(got[i].score - x.score) < 1e-6


def test_bloom_lm_keeps_every_pair(spark):
    texts = [prose(i, 12_000) for i in range(6)]
    model = bloomlm.train(make(spark, list(enumerate(texts))))
    h = [WordHashes().array(t.encode().split()) for t in texts]
    assert all((model.pair_counts(bloomlm.pair_keys(x[:-1], x[1:])) > 0).all() for x in h)
    assert len(model.bits) * 8 <= bloomlm.FILL * sum(len(x) + 2 for x in h) + 64 * model.groups
    other = WordHashes().array([w.encode() + b"!" for w in prose(99, 20_000).split()])
    assert (model.pair_counts(bloomlm.pair_keys(other[:-1], other[1:])) > 0).mean() < 0.02


def test_bloom_lm_edges(odd, none):
    assert bloomlm.scores(odd).count() == 10 and bloomlm.scores(none).count() == 0


def test_packing(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(i, prose(i, 5 + 37 * (i % 60))) for i in range(120)] + [(200, "a <|endoftext|> b"), (201, "éЖ\U0001f600 " * 900)]
    got = packing.pack(make(spark, rows)).collect()
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    for i, t in rows:
        ids = np.array([*real.encode(t, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by[i], key=lambda x: x.piece)
        assert [x.ids_crc32 for x in mine] == [zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in mine]
        assert sum(x.length for x in mine) == len(ids) and [x.length for x in mine[1:]] == [2048] * (len(mine) - 1)
    places = {}
    for x in got:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(x.length for x in got)
    assert len(places) <= 1.1 * total / 2048 + 1
    assert packing.pack(odd).where("length = 1").count() == 2 and packing.pack(none).count() == 0


def test_packer_equals_a_list_of_bins():
    r = random.Random(2)
    for most in (1, 3, 50):
        packer, bins, made = packing.Packer(40, most), [], 0
        for _ in range(400):
            n = r.randint(1, 40)
            k, at = packer.put(n)
            fits = [b for b in bins if b[1] >= n]
            if fits:
                free = min(b[1] for b in fits)
                assert 40 - at == free and [k, free] in bins
                bins.remove([k, free])
            else:
                assert (k, at) == (made, 0)
                free, made = 40, made + 1
            if free - n:
                bins.append([k, free - n])
            if len(bins) > most:
                least = min(b[1] for b in bins)
                gone = [b for b in bins if b[1] == least]
                bins.remove(max(gone, key=bins.index))  # the one put in last


def test_packer_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.put(n) for n in (6, 7, 2)] == [(0, 0), (1, 0), (1, 7)]
    assert p.put(9) == (2, 0)  # three bins are open now: that with one place left closes
    assert p.put(1) in ((1, 9), (2, 9))


def test_licenses(spark, odd, none):
    texts = {1: "MIT License. mit-license", 2: "Licensed under teh Apache Lisence, Version 2.0.", 3: "This work is licensed under the GNU General Public License, version 3.", 4: prose(1, 200), 5: "mit mit license"}
    got = {x.doc_id: x for x in licenses.scan(make(spark, list(texts.items()))).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (4, 2, 0, 2, "mit")
    assert got[2].base_labels == "" and got[2].labels == "apache" and 0 < got[2].score < 1 and got[2].spans[0].edits <= 4
    assert got[3].labels == "gpl" and got[3].first_word == 7 and got[4].labels == "" and got[4].first_word is None and got[5].first_word == 1
    assert licenses.scan(odd).count() == 10 and licenses.scan(none).count() == 0


def test_fuzzy_search_equals_search_everywhere():
    import regex

    scanner, r = licenses.Scanner(), random.Random(8)
    for notice, _, errors in licenses.NOTICES:
        k = licenses.NOTICES.index((notice, _, errors))
        for _ in range(5):
            w = bytearray(notice)
            for _ in range(errors):
                w[r.randrange(len(w))] = ord("q")
            plain = b"some words " + bytes(w) + b" more words"
            assert any(f[0] == k for f in scanner.find(plain)) == bool(regex.search(rb"(?:" + regex.escape(notice) + rb"){e<=%d}" % errors, plain))


def test_all_notices_that_stand_together():
    scanner = licenses.Scanner()
    spans = lambda text: [(text[s:e].decode(), d) for _, s, e, d in sorted(scanner.find(text), key=lambda x: x[1:])]
    assert spans(b"foo licensed under the apache licence version 2 0 bar licensed under the apache license version 2 0 baz") == [("licensed under the apache licence version 2 0", 1), ("licensed under the apache license version 2 0", 0)]
    assert spans(b"x all right reserved y z all rights reserved") == [("all right reserved", 1), ("all rights reserved", 0)]
    r = random.Random(4)
    for notice, _, errors in licenses.NOTICES:
        k = [n for n, _, _ in licenses.NOTICES].index(notice)
        copies = []
        for _ in range(60):
            w = bytearray(notice)
            for at in r.sample(range(1, len(w) - 1), r.randint(0, errors)):
                w[at] = ord("q")
            copies.append(bytes(w))
        text, want = b"", []
        for w in copies:
            text += b"xyz "
            want.append((len(text), len(text) + len(w), sum(a != b for a, b in zip(w, notice, strict=True))))
            text += w + b" "
        assert sorted(x[1:] for x in scanner.find(text) if x[0] == k) == want


def test_warc_round_trip(spark):
    r = random.Random(9)
    big = "".join(r.choice("abc\r\n é") for _ in range(90_000))
    rows = [(1, "http://a/1", big), (2, "http://a b/2", big), (3, None, None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "y" * 1000), (9, "u", "y" * 1000), (8, "u", "y" * 1000), (10, "u", "z\r\n\r\nWARC/1.1\r\n" * 50)]
    pages = spark.createDataFrame([(a, b, c, "k") for a, b, c in rows], "page_id bigint, url string, html string, kind string")
    got = {x.key: x for x in warc.round_trip(pages).collect()}
    assert len(got) == len(rows) and not any(x.problem for x in got.values())
    for i, _, t in rows:
        raw = (t or "").encode()
        assert (got[i].payload_bytes, got[i].digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].kind, got[i].refers) == {1: ("revisit", 2), 7: ("revisit", 9), 8: ("revisit", 9)}.get(i, ("response", None))
        if got[i].kind == "response":
            assert got[i].payload == raw
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_archives_that_break_off(spark, tmp_path):
    import gzip

    whole = b"".join(r + b"\r\n\r\n" for k in range(3) for r in warc.records(k, "u", b"text %d" % k, hashlib.sha1(b"text %d" % k).hexdigest(), None, f"6ba7b811-9dad-11d1-80b4-00c04fd430c{k}"))
    packed = gzip.compress(whole)
    files = {"a.warc.gz": packed, "b.warc": whole[:-20], "c.warc.gz": packed[:-30], "d.warc.gz": gzip.compress(whole[:100]) + gzip.compress(whole[100:]), "e.warc": b"", "f.warc": b"no record"}
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(data)
    got = {name: [(x.key, x.problem is None) for x in warc.read(spark, str(tmp_path / name)).orderBy("key").collect()] for name in files}
    fine = [(0, True), (1, True), (2, True)]
    assert got["a.warc.gz"] == got["d.warc.gz"] == fine and got["e.warc"] == [] and got["f.warc"] == [(None, False)]
    assert got["b.warc"] == [(None, False), *fine[:2]] and got["c.warc.gz"][0] == (None, False) and len(got["c.warc.gz"]) <= 3


def test_warc_notes_missing_segments():
    import pyarrow as pa

    ident = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    parts = [dict(zip(("origin", "number", "total", "kind", "key", "refers", "digest", "url", "block", "wrong"), p, strict=True)) for x in warc.records(1, "u", b"q" * 50_000, "0", None, ident) for p in warc.parse(x + b"\r\n\r\n")]
    assert [p["number"] for p in parts] == [1, 2]
    out = next(warc.assemble(iter([pa.RecordBatch.from_arrays([pa.array([parts[:1], parts])], ["parts"])])))
    assert out.column("problem").to_pylist() == ["segments are missing or their length is wrong", "the digest is wrong"]
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabcdefgh")


def test_audio(spark, odd, none):
    got = {x.doc_id: x for x in audio.summaries(audio.media(odd)).collect()}
    assert got[1].payload_bytes == 64 and got[1].n_bytes == 0 and got[4].feature == got[5].feature and got[4].media_sha256 == got[5].media_sha256
    raw = b"naive text"
    payload = audio.to_payload("naive text")[1]
    assert audio.from_wav(audio.to_wav(payload)) == payload == raw + b"\0" * 54
    assert audio.summaries(audio.media(none)).count() == 0
    table = audio.as_tensors(audio.features(audio.media(odd)).toArrow())
    assert table.column("tensor").type.shape == [audio.FRAMES, audio.BANDS]


def test_audio_blocks_and_filters():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 64 * 3000, dtype=np.uint8).tobytes()
    whole = audio.log_mel(data)
    before, audio.BLOCK = audio.BLOCK, 37
    try:
        assert np.abs(audio.log_mel(data) - whole).max() < 1e-3
    finally:
        audio.BLOCK = before
    x = np.zeros(400, np.float32)
    x[:] = np.sin(np.arange(400) * 2 * np.pi * 500 / audio.RATE)
    y = audio.resample(x)
    t = np.arange(40, 200)
    fit = np.stack([np.sin(t * 2 * np.pi * 500 / audio.OUT_RATE), np.cos(t * 2 * np.pi * 500 / audio.OUT_RATE)], axis=1)
    rest = y[40:200] - fit @ np.linalg.lstsq(fit, y[40:200], rcond=None)[0]
    assert np.abs(rest).max() < 0.02
    assert audio.segments(np.array([0, 5, 3, 5, 0, 0.0])).tolist() == [[1, 3]]


def test_audio_energies_equal_a_plain_version():
    data = np.random.default_rng(4).integers(0, 256, 64 * 40, dtype=np.uint8)
    x = (data.astype(np.float64) - 128) / 128
    n = audio.UP * audio.TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / audio.DOWN) * np.hamming(n)
    h *= audio.UP / h.sum()
    wide = np.zeros(len(x) * audio.UP)
    wide[:: audio.UP] = x
    whole = np.convolve(wide, h)[(audio.TAPS - 1) * audio.UP :: 1]
    mel = audio.log_mel(data.tobytes())
    fits = []
    for shift in range(audio.DOWN * audio.UP):  # the filter's delay is free
        y = whole[shift :: audio.DOWN][: len(x) * audio.UP // audio.DOWN]
        parts = np.stack([y[k * audio.HOP : k * audio.HOP + audio.WINDOW] for k in range(3)])
        power = np.abs(np.fft.rfft(parts * np.hanning(audio.WINDOW), axis=1)) ** 2
        fits.append(np.abs(np.log(power @ audio._BANDS + 1e-6) - mel[:3]).max())
    assert min(fits) < 0.05


def test_audio_gives_all_segments(spark, monkeypatch):
    stored = []
    write = audio.write_shared
    monkeypatch.setattr(audio, "write_shared", lambda df, name, *x: stored.append(name) or write(df, name, *x))
    text = ("\x01" * 3000 + prose(5, 600)) * 12
    table = audio.media(make(spark, [(1, text)]))
    feature = audio.summaries(table).first().feature
    spans = [f"{x.start_ms}-{x.end_ms}" for x in audio.segment_spans(table).orderBy("segment").collect()]
    assert len(spans) > 8 and f" segments={len(spans)} ms={';'.join(spans)} " in feature and stored == ["media", "tensors"]


def test_audio_hears_the_end(spark):
    base = prose(3, 400)[:1984]
    rows = [(n, base[: 1984 - 64 * n] + "a" * 40 + end) for n in range(6) for end in ("x" * 24, "\x01" * 24)]
    got = audio.summaries(audio.media(make(spark, rows))).collect()
    assert len({x.feature for x in got}) == len(rows)
    assert [len(audio.log_mel(b"x" * n)) for n in (64, 320, 384, 512, 576)] == [1, 1, 2, 2, 3]
