import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import copies, leaks, overlap

WORD = re.compile(r"[^\W_]+")
SCHEMA = "case_id bigint, prefix string, line_hash string, split string, source string, key string, id bigint, n int, rep bigint, bag string"


def words(t):
    return WORD.findall(t.lower().replace("'", "").replace("’", ""))


def cases(spark, texts, hashes=None):
    """Extra columns carry names that the operators use inside."""
    rows = [(i, t, (hashes or {}).get(i), "test", " Blogs", "x", 7, 1, 2, "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def edited(rng, base, k):
    out = list(base)
    for _ in range(k):
        j = rng.randrange(len(out))
        if rng.random() < 0.5:
            out[j] = f"new{rng.randrange(10**6)}"
        else:
            del out[j]
    rng.shuffle(out) if rng.random() < 0.3 else None
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for n in (12, 13, 15, 20, 30, 60, 64, 66, 75, 80, 82, 120, 1500):
        for _ in range(4):
            base = [rng.choice(vocab) if rng.random() < 0.7 else rng.choice(["the", "a", "of"]) for _ in range(n)]
            out += [base, edited(rng, base, 1), edited(rng, base, max(1, n // 6)), edited(rng, base, n // 4), base]
    out = [(i, " ".join(b)) for i, b in enumerate(out)]
    return out + [(900, None), (901, ""), (902, "..."), (903, "too short"), (904, out[0][1].upper() + "!"), (None, out[0][1])]


def near(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    n, m = sum(x.values()), sum(y.values())
    return min(n, m) >= 12 and 5 * sum((x & y).values()) >= 4 * max(n, m)


def content(t):
    return "".join(c for c in t.lower() if c.isalnum())


def test_near_pairs_against_brute_force(spark, texts):
    got = sorted(map(tuple, overlap.near_pairs(cases(spark, texts)).collect()))
    own = [(i, t) for i, t in texts if i is not None and t]
    want = sorted((i, j) for i, a in own for j, b in own if i < j and near(a, b) and content(a) != content(b))
    assert got == want and len(want) > 50
    links = {r.case_id: r for r in overlap.near_links(cases(spark, texts)).collect()}
    both = Counter(i for p in want for i in p)
    assert {i: r.links for i, r in links.items()} == {i: both[i] for i, t in own if len(words(t)) >= 12}
    same = {(content(t), tuple(sorted(words(t)))): [] for _, t in own}
    for i, t in own:
        same[content(t), tuple(sorted(words(t)))].append(i)
    assert all(links[i].class_id == min(m) for m in same.values() for i in m if i in links)


@pytest.mark.parametrize(("spread", "many"), [(1 << 20, 256), (5, 256), (5, 6), (1 << 20, 30)])
def test_shared_lines_against_brute_force(spark, texts, monkeypatch, spread, many):
    monkeypatch.setattr(overlap, "SPREAD", spread)
    monkeypatch.setattr(overlap, "MANY", many)
    rng = random.Random(6)
    lines = [(i, " ".join(words(t or "") + [f"tail{rng.randrange(99)}" for _ in range(rng.randrange(30))])) for i, t in texts[::2] if i is not None] + [(5000, None), (5001, "")]
    hashes = {1: "ABC", 2: "abc", 3: None, 900: "ff"}
    line_rows = [(i, t, {0: "aBc", 5000: "FF"}.get(i), 1) for i, t in lines]
    line_df = spark.createDataFrame(line_rows, "line_id bigint, text string, line_hash string, n int")
    got = sorted(map(tuple, overlap.shared_lines(cases(spark, texts, hashes), line_df).collect()))
    want = set()
    for i, t in texts:
        for j, u, h, _ in line_rows:
            x, y = Counter(words(t or "")), Counter(words(u or ""))
            n = sum(x.values())
            if i is not None and (h and hashes.get(i) and h.lower() == hashes[i].lower() or n >= 12 and 5 * sum((x & y).values()) >= 4 * n):
                want.add((i, j))
    assert got == sorted(want) and len(want) > 60
    if (spread, many) == (5, 6):
        return
    links = {r.case_id: r for r in overlap.line_links(cases(spark, texts, hashes), line_df).collect()}
    for i, t in texts:
        x = Counter(words(t or ""))
        n = sum(x.values())
        if i is None or n < 12 and not hashes.get(i):
            assert i not in links
            continue
        assert links[i].by_hash == sum(bool(h and hashes.get(i)) and h.lower() == hashes[i].lower() for _, _, h, _ in line_rows)
        assert links[i].by_words == sum(n >= 12 and 5 * sum((x & Counter(words(u or ""))).values()) >= 4 * n for _, u, _, _ in line_rows)


def test_postings_grow_with_words_only():
    """A line of n words gives n - 9 postings, however frequent its words are in a larger table."""
    rng = np.random.default_rng(1)
    bags = pa.array([np.sort(rng.integers(0, 2000, 27)) for _ in range(300)], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), bags], names=["id", "bag"])
    counts = np.bincount(bags.flatten().to_numpy() & (overlap.BUCKETS - 1), minlength=overlap.BUCKETS)
    for times in (1, 10, 100, 10_000):
        got = [b.num_rows for b in overlap._line_posts(SimpleNamespace(value=counts * times))([batch])]
        assert sum(got) == 300 * 18


def test_a_third_in_one_class(spark):
    base = " ".join(f"v{i}" for i in range(20))
    other = base.replace("v3 ", "q ")
    rows = [(i, base) for i in range(300)] + [(1000 + i, " ".join(f"u{i}x{j}" for j in range(15))) for i in range(300)] + [(5000, other)]
    got = overlap.near_pairs(cases(spark, rows)).collect()
    assert sorted(r.case_a for r in got) == list(range(300)) and {r.case_b for r in got} == {5000}


def test_report(spark):
    c = cases(spark, [(1, "a"), (2, "b"), (2, "b")])
    pairs = spark.createDataFrame([(1, 5), (1, 6)], "case_id bigint, line_id bigint")
    assert [tuple(r) for r in overlap.overlap_report(c, pairs).collect()] == [("test", "blogs", 3, 1, 2)]


def test_copies_and_records(spark):
    json = '{"topic": "old mill", "body": "it\\u0027s  a \\"day\\"", "mood":"odd"}'
    rows = [
        (5, "Can't believe IT!"), (3, "cant   believe, it"), (9, "can’t-believe it"), (4, json), (2, "mood: odd | body: It's a day | topic: old mill"), (8, "topic=old mill; mood=odd; body=its a day"),
        (11, "topic old mill mood odd body its a day"), (12, None), (13, "!!!"), (14, ""), (15, "alone"), (16, "mood: odd | body: other | topic: old mill"),
    ]
    got = sorted(map(tuple, copies.superfluous(cases(spark, rows)).collect()))
    assert got == [(2, 4), (2, 8), (3, 5), (3, 9)]
    assert {(r.keep_id, r.copies) for r in copies.collapsed(cases(spark, rows)).collect()} == {(2, 3), (3, 3), (11, 1), (15, 1), (16, 1)}


def test_copies_across_partitions(spark):
    rows = [(i, "same text") for i in range(2000, 0, -1)] + [(5000 + i, f"text {i % 700}") for i in range(1400)]
    got = {(r.case_id): r.keep_id for r in copies.superfluous(cases(spark, rows).repartition(7)).collect()}
    assert len(got) == 1999 + 700 and all(got[i] == 1 for i in range(2, 2001)) and all(got[5700 + i] == 5000 + i for i in range(700))


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    pool = [[f"p{i}w{j}" for j in range(40)] for i in range(6)]
    items = [(i, " ".join(p)) for i, p in enumerate(pool)] + [(6, " ".join(pool[0][20:] + pool[1][:20])), (7, None), (8, "short one"), (None, "x")]
    docs = []
    for d in range(60):
        filler = [f"f{rng.randrange(50)}" for _ in range(rng.randrange(60))]
        p, n = rng.choice(pool), rng.choice([5, 11, 12, 13, 30])
        at = rng.randrange(40 - n + 1)
        docs.append((d, " ".join(filler[: len(filler) // 2] + p[at : at + n] + filler[len(filler) // 2 :])))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (102, docs[0][1]), (103, " ".join(f"x{i}" for i in range(30000)) + " " + items[2][1])]
    d = spark.createDataFrame([(i, t, 1, "h") for i, t in docs], "doc_id bigint, text string, h int, near string")
    it = spark.createDataFrame([(i, t, "test") for i, t in items], "item_id bigint, text string, reserve_role string")
    runs = lambda t: {tuple(w[k : k + 12]) for w in [words(t or "")] for k in range(len(w) - 11)}
    want = sorted({(i, j) for i, t in docs for j, u in items if j is not None and runs(t) & runs(u)})
    pairs = leaks.leaks(d, it)
    assert sorted(map(tuple, pairs.collect())) == want and len(want) > 20
    assert sum(r.documents for r in leaks.leak_report(it, pairs).collect()) == len(want)


def test_empty_tables(spark):
    none = cases(spark, [(1, "x")]).limit(0)
    lines = spark.createDataFrame([], "line_id bigint, text string, line_hash string")
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string, reserve_role string")
    for df in (overlap.near_pairs(none), overlap.near_links(none), overlap.shared_lines(none, lines), overlap.line_links(none, lines), copies.superfluous(none), copies.collapsed(none), leaks.leaks(docs, items)):
        assert df.count() == 0
