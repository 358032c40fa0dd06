"""Vector codes, benchmark decontamination and tokenizer alignment against brute force, on tables with the awkward cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import alignment, decontaminate, vector_codes


# -- vector codes -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("span", [2, 40, 1 << 23])
def test_filtering_equals_all_distances(span):
    """Boxes decide as single points do: also for ties, equal points, equal entries and single points."""
    rng = np.random.default_rng(span)
    for n in (1, 2, 40, 900):
        points = rng.integers(-span, span + 1, (n, 4))
        points[rng.random(n) < 0.4] = points[0]
        entries = rng.integers(-span, span + 1, (rng.integers(1, 65), 4))
        entries[-1] = entries[0]
        own, sums, counts = vector_codes.assigned(vector_codes.kd_tree(points.astype(np.int32)), entries)
        want = ((points[:, None] - entries[None]) ** 2).sum(-1).argmin(1)
        assert (own == want).all()
        for k in range(len(entries)):
            assert (sums[k] == points[want == k].sum(0)).all() and counts[k] == (want == k).sum()


def test_subtrees_are_assigned_without_looking_at_points():
    points = np.concatenate([np.random.default_rng(1).integers(0, 9, (500, 2)), np.random.default_rng(2).integers(1000, 1009, (500, 2))])
    tree = vector_codes.kd_tree(points)
    tree.points = np.full_like(points, 500)  # would be wrong, but no leaf is reached
    own, sums, counts = vector_codes.assigned(tree, np.array([[4, 4], [1004, 1004]]))
    assert (own == np.repeat([0, 1], 500)).all() and (sums.sum(0) == points.sum(0)).all()


def _brute_codes(rows, parts, entries, rounds):
    good = [(i, v, label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    good = sorted(((i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], label) for i, v, label in good), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1]) if good else 0
    good = [r for r in good if len(r[1]) == width]
    step = width // parts
    cut = [[r[1][p * step : (p + 1) * step] for r in good] for p in range(parts)]
    books = [list(map(list, c[:entries])) for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, v: min(range(len(books[p])), key=lambda k: (far(v, books[p][k]), k))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(p, v) for v in cut[p]]
            books[p] = [[sum(c) // len(c) for c in zip(*(v for v, k in zip(cut[p], own) if k == e))] if e in own else books[p][e] for e in range(len(books[p]))]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, errors = [], Counter()
    for n, (i, _, label) in enumerate(good):
        own = [near(p, cut[p][n]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k in own), sum(far(cut[p][n], books[p][k]) for p, k in enumerate(own)), label))
        errors[label] += out[-1][2]
    return [(i, code, e, errors[label], digest) for i, code, e, label in out]


def test_vector_codes(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 30)
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], rng.choice([None, 1, 2])) for k in range(110)]
    rows += [(k, rows[3][1], 1) for k in range(110, 150)]  # one frequent vector
    rows += [(7, rows[9][1], 2), (None, [0.0] * 8, None), (200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] + [0.0] * 7, 1), (204, [1.0] * 7, 1), (205, [1.0] * 12, 1), (206, [], 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    for entries in (10, 200):
        got = sorted(map(tuple, vector_codes.vector_codes(df, parts=4, entries=entries).collect()), key=repr)
        assert got == sorted(_brute_codes(rows, 4, entries, vector_codes.ROUNDS), key=repr)
    assert vector_codes.vector_codes(df.limit(0), parts=4).collect() == []
    huge = vector_codes.vector_codes(spark.createDataFrame([(1, [3e38, -3e38], None)], "vec_id long, embedding array<float>, label int"), parts=2).first()
    assert (huge["code"], huge["error"], huge["label_error"]) == ("0000", 0, 0)
    names = sorted(map(tuple, vector_codes.vector_codes(df.select(F.col("vec_id").alias("my id"), F.col("embedding").alias("q_x"), F.col("label").alias("q_label")), "my id", "q_x", "q_label", parts=4, entries=10).collect()), key=repr)
    assert names == sorted(_brute_codes(rows, 4, 10, vector_codes.ROUNDS), key=repr)


# -- decontamination --------------------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _split(text):
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute_hits(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        ws = _split(text)
        for i in range(max(1, len(ws) - size + 1) if ws else 0):
            windows[tuple(ws[i : i + size])].add(item or "")
    out = []
    for doc, text in docs:
        ws, hit, found = _split(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(ws[i : i + n])]
        out.append((doc, len(ws), len(hit), sorted(found), bool(hit)))
    return out


ITEM = "One, two three four five SIX seven eight nine ten eleven Twelve thirteen."


@pytest.fixture(scope="module")
def items():
    return [("b", ITEM), ("a", ITEM.upper()), ("c", "six seven eight nine ten eleven twelve thirteen fourteen fifteen"), ("short", "Ünder 3 words"), ("none", None), ("marks", "... !"), ("", "é É"), (None, "solo"), ("b", "also b here it is the tenth word of this item")]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [(1, f"x {ITEM} y"), (2, ITEM.replace(" ", "\n--")), (3, " ".join(ITEM.split()[1:11])), (4, " ".join(ITEM.split()[:9])), (5, None), (6, ""), (7, "?!"), (8, "Ünder, 3 WORDS; ünder 3 words"), (9, "é É"), (9, "é É"), (None, "solo SOLO"), (None, None)]
    out += [(10, ITEM * 400), (11, "solo " * 3000), (12, ITEM + " fourteen fifteen"), (13, "the tenth word of this item also b here it is the tenth word of this item")]
    words = _split(ITEM) + ["solo", "é"]
    return out + [(20 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(60)]


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 3])
def test_benchmark_hits(spark, items, texts, block):
    """Whatever the number of blocks; rows that repeat each give a row."""
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, h string, at int").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.benchmark_hits(docs, benchmark, block=block)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()), key=repr) == sorted(_brute_hits(texts, items), key=repr)


def test_hits_are_removed(spark, items, texts):
    docs = spark.createDataFrame([(i, t, 5, "w") for i, t in texts], "doc_id long, text string, q_sha int, ws string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    rest = decontaminate.decontaminated(docs, benchmark, "documents")
    want = _brute_hits(texts, items)
    assert rest.columns == docs.columns and sorted((r["doc_id"] for r in rest.collect()), key=repr) == sorted((w[0] for w in want if not w[4]), key=repr)
    cut = decontaminate.decontaminated(docs, benchmark)
    assert cut.columns == docs.columns and cut.count() == len(texts)
    rows = {r["doc_id"]: r["text"] for r in cut.where("doc_id < 14").collect()}
    assert (rows[1], rows[2], rows[4], rows[5], rows[6], rows[7], rows[10]) == ("x y", "", texts[3][1], None, "", "?!", "")
    for r in cut.collect():
        before = [w for d, w in ((d, w) for d, w in zip([t[0] for t in texts], want)) if d == r["doc_id"]]
        assert len(_split(r["text"])) in {w[1] - w[2] for w in before}


def test_without_benchmark_or_documents(spark, items, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    rows = decontaminate.benchmark_hits(docs, benchmark.limit(0)).collect()
    assert len(rows) == len(texts) and not any(r["contaminated"] or r["n_hit"] or r["items"] for r in rows)
    assert decontaminate.benchmark_hits(docs.limit(0), benchmark).collect() == []
    many = spark.createDataFrame([(str(k), f"{ITEM} {k % 7}") for k in range(300)], "item_id string, text string")  # a window that all items have
    assert len(decontaminate.benchmark_hits(docs.where("doc_id = 1"), many).first()["items"]) == 300


# -- alignment --------------------------------------------------------------------------------------------------------


def _brute_alignment(rows):
    a, b, a_bytes, b_bytes = alignment._models(alignment.A_VOCABULARY, alignment.B_VOCABULARY)
    found = []
    for i, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or any(b"".join(table[x] for x in ids) != (" " + text).encode() for table, ids in ((a_bytes, ids_a), (b_bytes, ids_b))):
            found.append((i, None))
            continue
        ends = [np.cumsum([len(table[x]) for x in ids]).tolist() for table, ids in ((a_bytes, ids_a), (b_bytes, ids_b))]
        groups, x, y = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((ids_a[x:p], ids_b[y:q]))
            x, y = p, q
        found.append((i, (len(ids_a), len(ids_b), groups, Counter((u, v) for p, q in groups for u in p for v in q))))
    count, best = Counter(), Counter()
    for _, d in found:
        count.update(set(d[3]) if d else ())
    for (u, _), n in count.items():
        best[u] = max(best[u], n)
    out = []
    for i, d in found:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in d[2])
        out.append((i, d[0], d[1], len(d[2]), sum(d[3].values()), sum(m for k, m in d[3].items() if count[k] == best[k[0]]), sum(m * count[k] for k, m in d[3].items()), hashlib.sha256(shown.encode()).hexdigest()))
    return out


PARTS = ["a", "the", "Word", "é", " ", "  ", "\n", "\t", "\r", " \n", "\x1c", "\xa0", "　", "▁", "<0x41>", "<|endoftext|>", "<s>", "日本", "😀", "'s", "12", "...", "\x00", "½", "ﬁ", "z" * 70, "don't", "\x85"]


@pytest.mark.parametrize("bounds", [{}, {"REMEMBERED": 20_000, "JOINED": 100, "LISTED": 6, "SUMMED": 500, "SHARE": 4_000}])
def test_alignment(spark, monkeypatch, bounds):
    """Units, however they are put together and however few are remembered, give what whole texts give."""
    for name, value in bounds.items():
        monkeypatch.setattr(alignment, name, value)
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))) for k in range(300)] + [(None, "x y"), (7, "x y"), (7, "x y"), (400, None), (401, ""), (402, " "), (403, "\n"), (404, "ab" * 2000 + "\x01\x02" * 1500), (405, "the Word " * 4000)]
    alignment._aligner.cache_clear()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, blob string, row int").repartition(4)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [tuple(r) for r in alignment.aligned(df).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(_brute_alignment(rows), key=repr)
    assert alignment.aligned(df.limit(0)).collect() == []


def test_units_and_memory(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 30_000)
    own = alignment.Aligner()
    rng = random.Random(6)
    most = 0
    for _ in range(20):
        own.aligned([" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 80))) for _ in range(40))])
        most = max(most, len(own.known))
        assert len(own.known) == len(own.shown) == len(own.sizes) == len(own.ends) - 1 and own.ends[-1] == len(own.pairs) == len(own.times)
        assert all(len(u) <= alignment.LONGEST for u in own.known)
    assert most < 200


def test_bits():
    rng = np.random.default_rng(7)
    places = np.flatnonzero(rng.random(1000) < 0.3)
    bits = alignment.Bits.at(places, 1000)
    assert (bits.places() == places).all() and (bits.rank(np.arange(1000)) == [np.sum(places < k) for k in range(1000)]).all()
