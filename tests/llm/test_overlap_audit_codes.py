"""Jaccard links, filter audits and vector codes against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from arrayloom.llm import audit, codes, overlap, shingles, simhash

WORD = re.compile("[^\x20\x09-\x0d]+")
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards boil a pot of green tea and sing about rivers of the far north"
ODD = [
    (1, PROSE, "a"), (2, PROSE.upper(), "a"), (2, PROSE, "a"), (3, PROSE + " now", "b"), (4, None, None), (5, "", "b"), (6, " \t\n", ""), (6, " \t\n", "a"), (7, "x", "c"), (8, "X", "c"),
    (9, "same " * 4000, "a"), (10, "same " * 10, "a"), (None, PROSE, "a"), (None, "alone with no id at all", "b"), (11, "w" * 5000, "c"), (11, "other text of one id # here", "c"),
    (12, "日本語 テスト 😀 ①\u0085é", "b"), (13, "A B C D E F G H", "b"), (14, "one two three", "b"), (15, "One Two Three", "b"), (16, PROSE, None),
]


def shingle_set(t, n=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([" ".join(w)] if w else [])


def brute_groups(rows, least=85, n=4):
    """Counter of (doc_id, n_shingles, component_id); nodes are rows."""
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= least * max(len(x), len(y)) and 100 * len(x & y) >= least * len(x | y):
            root[find(a)] = find(b)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    lowest = {r: min((d for d in found if d is not None), default=None) for r, found in ids.items()}
    return Counter((doc, len(sets[i]), lowest[find(i)]) for i, (doc, _) in enumerate(rows))


def links(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, node int, size int, tokens string")
    return Counter(map(tuple, overlap.ngram_groups(df, **more).collect()))


def test_links_of_odd_rows(spark):
    rows = [(i, t) for i, t, _ in ODD]
    assert links(spark, rows) == brute_groups(rows)
    assert links(spark, []) == Counter()


def test_links_of_sample_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert Counter(map(tuple, overlap.ngram_groups(docs).collect())) == brute_groups([tuple(r) for r in docs.collect()])


def variants(seed, texts, copies, length, changes):
    """Texts with copies, each with some words changed, and passages that many texts share."""
    r, out = random.Random(seed), []
    word = lambda: f"w{r.randrange(5000)}"
    passages = [[word() for _ in range(length // 3)] for _ in range(4)]
    for _ in range(texts):
        base = [word() for _ in range(length)]
        for p in r.sample(passages, r.randrange(4)):
            at = r.randrange(length)
            base[at:at] = p
        for _ in range(r.randrange(1, copies)):
            w = list(base)
            for _ in range(r.randrange(changes)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w[r.randrange(3) :]))
    # Sets made of common passages alone have all their tokens in others.
    out += [" ".join(sum((r.choice(passages) for _ in range(3)), [])) for _ in range(40)]
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_at_the_threshold(spark, seed):
    rows = variants(seed, 12, 20, 150, 9)
    want = brute_groups(rows)
    assert any(i != c for i, _, c in want) and len({c for *_, c in want}) > 20
    assert links(spark, rows) == want


def test_links_across_small_groups(spark, monkeypatch):
    """With chunks of a few sets and poor keys nearly all links are found through the matrix."""
    monkeypatch.setattr(overlap, "MEMBERS", 3)
    monkeypatch.setattr(overlap, "COLUMNS", 64)
    rows = variants(3, 6, 25, 120, 8)
    alone = lambda nodes: nodes.select("node", nodes["node"].alias("label"))
    assert links(spark, rows) == brute_groups(rows)
    monkeypatch.setattr(overlap, "leaders", alone)
    assert links(spark, rows) == brute_groups(rows)


def test_links_of_other_sizes(spark):
    rows = variants(4, 5, 10, 60, 6)
    assert links(spark, rows, n=2, least=70) == brute_groups(rows, 70, 2)


def test_sets_of_one_mark_stay(spark):
    """Two sets whose digests begin alike aren't judged by each other's tokens."""
    nodes = spark.createDataFrame([(1, 7, 10), (2, 7, 10), (3, 8, 10), (4, 9, 2)], "node long, mark long, size long")
    sketches = spark.createDataFrame([(7, [1, 2]), (7, [3]), (8, [4, 5]), (9, [])], "mark long, sample array<long>")
    assert {r.node for r in overlap.not_alone(sketches, nodes, 85).collect()} == {1, 2, 4}


def brute_audit(rows, labels):
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    marked = []
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > low[t]]
        own = [x for x in labels if x[0] == i and i is not None]
        marked.append((part or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for order in itertools.permutations(range(5)):
        for part, fails, good, toxic in marked:
            gone = False
            for k, f in enumerate(order):
                row = out.setdefault((part, "".join("ABCDE"[x] for x in order), k + 1), [0] * 6)
                here = fails[f] and not gone
                row[2] += fails[f] and gone
                gone = gone or here
                row[0] += not gone
                row[1] += here
                row[3] += fails[f] and sum(fails) == 1
                row[4] += here and good
                row[5] += here and toxic
    total = Counter()
    for (part, order, k), row in out.items():
        total[part, order[k - 1]] += row[1]
    return Counter((*key, *map(int, row), total[key[0], key[1][key[2] - 1]]) for key, row in out.items())


def test_audit(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(i, t, p) for i, t, p in ODD] + [(100, long, "a"), (101, long, "a"), (102, long, "b"), (102, long, "b"), (103, "Cap " * 250, "a"), (104, long + " #", "c"), (None, long, "a"), (99, long + " #", "c")]
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (100, 1, 0), (101, 1, None), (102, None, 1), (None, 1, 1), (5000, 1, 1), (104, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, 1, True) for i, t, p in rows], "doc_id long, text string, source string, step int, good boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(docs, marks)
    assert dict(got.dtypes) | {"step": "int", "kept": "bigint", "shapley": "bigint", "part": "string"} == dict(got.dtypes)
    assert Counter(map(tuple, got.collect())) == brute_audit(rows, labels)
    assert audit.filter_audit(docs.filter("false"), marks).count() == 0
    assert audit.filter_audit(docs, marks.filter("false")).filter("good_lost > 0 or toxic_lost > 0").count() == 0


def test_lattice():
    assert len(audit.edges(5)) == len(set(audit.edges(5))) == 80
    paths = audit.steps("ABCDE")
    assert len(paths) == 600 and len({p[0] for p in paths}) == 120 and {p[2:] for p in paths} == set(audit.edges(5))


def brute_codes(rows, parts=8, entries=16, rounds=6):
    ok = [(i, v, n) for i, v, n in rows if v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    whole = [(i, [int(4096 * x // 1) for x in v], n) for i, v, n in ok]
    order = sorted(range(len(whole)), key=lambda k: (whole[k][0] is None, whole[k][0] or 0, whole[k][1]))
    length = len(whole[order[0]][1])
    w = length // parts
    fit = [k for k in order if len(whole[k][1]) == length]
    pieces = {k: [tuple(whole[k][1][p * w : p * w + w]) for p in range(parts)] for k in fit}
    book = [[pieces[k][p] for k in fit[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda p, a: min(range(len(book[p])), key=lambda e: (far(book[p][e], a), e))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for k in fit:
                own.setdefault(pick(p, pieces[k][p]), []).append(pieces[k][p])
            book[p] = [tuple(sum(c) // len(own[e]) for c in zip(*own[e])) if e in own else b for e, b in enumerate(book[p])]
    out = []
    for k in range(len(whole)):
        i, _, n = whole[k]
        if k in pieces:
            picked = [pick(p, pieces[k][p]) for p in range(parts)]
            out.append((i, "".join(f"{e:02x}" for e in picked), sum(far(book[p][e], pieces[k][p]) for p, e in enumerate(picked)), n))
        else:
            out.append((i, None, None, n))
    sums = Counter()
    for *_, e, n in out:
        sums[n] += e or 0
    sha = hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()
    return Counter((i, c, e, sums[n], sha) for i, c, e, n in out)


@pytest.mark.parametrize("count", [5, 60])
def test_codes(spark, count):
    r = random.Random(count)
    draw = lambda: [float(r.choice([-1, 1]) * r.randrange(300)) / 1000 for _ in range(16)]
    rows = [(i, draw(), r.choice([1, 2, None])) for i in range(count)]
    rows += [rows[0], (1, draw(), 2), (None, draw(), 1), (None, draw(), None)] + [(500 + i, rows[3][1], 1) for i in range(20)]
    rows += [(700, None, 1), (701, [float("nan")] * 16, 1), (702, [None] + [0.0] * 15, 1), (703, [float("inf")] + [0.0] * 15, 1), (704, [0.5] * 8, 1), (705, [], 2)]
    df = spark.createDataFrame([(*row, "x", 1) for row in rows], "vec_id long, embedding array<double>, label int, code string, part int")
    got = Counter(map(tuple, codes.vector_codes(df).collect()))
    assert got == brute_codes(rows)
    assert codes.vector_codes(df.filter("false")).count() == 0


def test_codes_out_of_range(spark):
    rows = [(1, [0.25] * 8, 1), (2, [1e6] * 8, 1), (3, [-0.25] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.code, r.error) for r in codes.vector_codes(df).collect()}
    assert got == {1: ("00" * 8, 0), 2: (None, None), 3: ("01" * 8, 0)}
    with pytest.raises(ValueError):
        codes.vector_codes(df, parts=3)
    with pytest.raises(ValueError):
        codes.vector_codes(df, entries=300)


def test_texts_that_share_a_digest(spark, monkeypatch):
    """Near-dedup tells texts apart whose 64-bit digests are equal."""
    words = [f"w{i:03}" for i in range(60)]
    other = [f"x{i:03}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words + ["end"])), (4, None), (5, " ".join(reversed(words))), (6, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1, 2, 4, 5}
    assert {r.doc_id for r in shingles.drop_alike(docs).collect()} == want
    monkeypatch.setattr(simhash, "digest", lambda t: F.length(F.coalesce(t, F.lit(""))).cast("long"))
    assert {r.doc_id for r in shingles.drop_alike(docs).collect()} == want
    few = spark.createDataFrame([(i, t) for i, t in enumerate(["xxxa", "xxxb", "xxxxa", "xxxxb"])], "doc_id long, text string")
    monkeypatch.setattr(simhash, "second", lambda t: F.ascii(F.right(t, F.lit(1))).cast("long"))
    with pytest.raises(RuntimeError):
        simhash.text_keys(few, "text")
