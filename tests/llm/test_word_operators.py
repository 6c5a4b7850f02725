"""Spelling variants, decontamination and periodic runs against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, periods, queries, spelling

#: Extra columns with names that the operators use inside.
EXTRA = ("word", "n", "_id", "_run", "_w", "_th", "_of", "_tt", "_s", "_doc", "_own", "_text", "_runs", "hash", "k", "item", "h", "g", "a", "p", "spans", "_spans", "_pieces")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", None, None if t is None else len(t), *(f"{c}{i}" for c in EXTRA)) for i, t in rows], SCHEMA).repartition(3)


# --- spelling ---


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n: dict) -> dict:
    near = defaultdict(set)
    by = defaultdict(list)
    for w in n:  # words one edit apart share a form with one letter deleted, or one is that form of the other
        for k in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by[k].append(w)
    for group in by.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def edited(doc, run):
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    k = h % len(run)
    return run[:k] + run[k + 1 :] if h % 97 == 0 else run


def spelling_texts():
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdeéñÿ", k=rng.randint(4, 12))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "bababab", "abcde" * 300]
    words = list(base)
    for w in base:
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÀ") + w[k:], w[:k] + rng.choice("abÉ") + w[k + 1 :]]))
    rows = [(i, " ".join(rng.choices(words, k=60)).upper() if i % 9 == 0 else "-".join(rng.choices(words, k=60))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "12 34 ?!"), (None, "aaaaa aaaaaa ababab"), (3, rows[3][1]), (3, rows[3][1]), (203, "ab " + "w" * 20_000)]
    rows += [(204, "kalimero " * 40 + "kalimera " * 20 + "kalimeram " * 10 + "kalimram " * 5)]  # a chain of forms
    return rows


def test_variants(spark):
    rows = spelling_texts()
    count = Counter(edited(i, run) for i, t in rows for run in (r.translate(LOWER) for r in re.findall("[A-Za-zÀ-ÿ]+", t or "")))
    docs = frame(spark, rows)
    counts = spelling.word_counts(docs, queries.misspelt)
    assert {r.word: r.n for r in counts.collect()} == dict(count)
    want = brute_variants({w: n for w, n in count.items() if len(w) >= 5 and n >= 3})
    got = spelling.variants(counts).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert any(v[0] and v[1] != v[0] for v in want.values())
    assert spelling.variants(spelling.word_counts(frame(spark, []))).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(counts, min_length=3)


def test_variants_of_the_test_table(spark):
    """Every document of sf0.01."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    count = Counter(edited(i, run) for i, t in rows for run in (r.translate(LOWER) for r in re.findall("[A-Za-zÀ-ÿ]+", t or "")))
    want = brute_variants({w: n for w, n in count.items() if len(w) >= 5 and n >= 3})
    got = queries.op11_spelling(spark, "/root/testdata/sf0.01").collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want) > 10_000


def test_variants_of_one_hot_bigram(spark):
    """Words that all share their bigrams: keys of what an edit leaves keep the groups small."""
    rng = random.Random(3)
    n = {"".join(rng.choices("ab", k=rng.randint(5, 14))): rng.randint(3, 90) for _ in range(2500)}
    got = spelling.variants(spark.createDataFrame([(w, c, "x") for w, c in n.items()], "word string, n long, a string")).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(n)


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(70)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w70"}


# --- decontamination ---

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def benchmark_rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcé日𝒳", k=rng.randint(1, 5))) for _ in range(60)]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, some(n)) for k, n in enumerate([25, 14, 10, 9, 4, 1, 30, 12])]
    items += [(50, None), (51, ""), (52, "?! --"), (None, some(15)), (7, items[7][1]), (8, items[6][1] + " " + some(3)), (9, "zu zu " * 9)]
    passage = lambda k: dict(items)[k]
    docs = [(0, None), (1, ""), (2, "...\n"), (3, passage(5)), (4, passage(0)), (5, some(40) + " " + passage(6) + "; " + some(30)), (6, " ".join(passage(1).split()[:9]))]
    docs += [(7, ", ".join(passage(2).upper().split()) + "."), (8, some(50) + passage(4) + some(5)), (9, "zu " * 40), (10, passage(None)), (11, f"{passage(0)}\n{passage(1)} x {passage(3)}")]
    docs += [(20 + k, some(rng.randint(1, 200))) for k in range(40)] + [(4, passage(0)), (4, some(9)), (None, passage(6)), (99, some(8000))]
    return docs, items


def brute_contamination(docs, items, size=10):
    grams = defaultdict(set)
    for i, t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            grams[tuple(w[k : k + size])].add(i)
    out = []
    for i, t in docs:
        w, hit, of = WORDS.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    of |= grams[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in of if x is not None)), bool(hit), frozenset(hit)))
    return out


def test_contamination(spark):
    docs, items = benchmark_rows()
    table, tests = frame(spark, docs), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hash string")
    want = brute_contamination(docs, items)
    got = decontaminate.contamination(table, tests).collect()
    mine = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated, frozenset(k for s in r.spans for k in range(s.s, s.e))) for r in got]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:3])
    assert sorted(mine, key=key) == sorted(want, key=key)
    assert decontaminate.contamination(table.limit(0), tests).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(table, tests.limit(0)).collect())


def test_decontaminate(spark, monkeypatch):
    docs, items = benchmark_rows()
    table, tests = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    want, any_word = brute_contamination(docs, items), re.compile(WORDS.pattern.replace(r"\x60", r"\x40\x5B-\x60"))
    cleaned = []
    for (i, t), (_, _, n, _, _, hit) in zip(docs, want, strict=True):
        out, last = [], 0
        found = list(any_word.finditer(t or ""))
        for k, m in enumerate(found):
            out.append((t or "")[last : m.start()] if k == 0 else "")
            last = found[k + 1].start() if k + 1 < len(found) else len(t)
            out.append("" if k in hit else t[m.start() : last])
        cleaned.append((i, "".join(out) if found else t))
    got = decontaminate.decontaminate(table, tests)
    assert got.columns == table.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(cleaned)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.word == f"word{r.doc_id}" for r in got.collect())
    kept = decontaminate.decontaminate(table, tests, remove="documents").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(d for d, w in zip(docs, want, strict=True) if not w[4])
    monkeypatch.setattr(decontaminate, "small_broadcast", lambda df: df)  # sets too large for a broadcast
    assert Counter((r.doc_id, r.text) for r in decontaminate.decontaminate(table, tests).collect()) == Counter(cleaned)


# --- periodic runs ---


def brute_runs(w: list) -> list:
    ids = {x: k for k, x in enumerate(dict.fromkeys(w))}
    a, least = np.array([ids[x] for x in w]), {}
    for p in range(1, len(a) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.r_[0, a[:-p] == a[p:], 0]))
        for lo, hi in edge.reshape(-1, 2):
            if hi - lo + p >= max(12, 2 * p):
                least.setdefault((int(lo), int(hi + p)), p)
    return sorted((s, e - s, p) for (s, e), p in least.items())


def collapsed(w: list, runs: list) -> str:
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def period_rows():
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (4, "a " * 11), (5, "a " * 12), (6, "ab " * 3000), (7, "x y " * 6), (8, "x y " * 5 + "x"), (9, "a b c d e f " * 2), (10, "a b c d e " * 2)]
    for i in range(150):
        letters, w = "ab" if i % 3 == 0 else "abcdefgh", []
        for _ in range(rng.randint(1, 6)):
            block = rng.choices(letters, k=rng.randint(1, 30))
            w += (block * rng.randint(1, 9))[: rng.randint(1, 200)] + rng.choices(letters, k=rng.randint(0, 20))
        rows.append((20 + i, rng.choice([" ", "  ", "\n"]).join(w)))
    line = "one line that comes again and again"
    rows += [(300, "\n".join([line] * 40 + ["another"] + [line] * 7)), (301, " ".join(rng.choices("ab", k=1500))), (302, "é 日 𝒳 " * 9), (302, "é 日 𝒳 " * 9), (None, "q r " * 20)]
    fib = ["a", "b"]
    while len(fib[-1]) < 1000:  # full of nested runs
        fib.append(fib[-1] + fib[-2])
    rows += [(303, " ".join(fib[-1])), (304, " ".join(rng.choices("abcdefghijklmnop", k=5000)))]
    return rows


@pytest.mark.parametrize("probes", [1 << 20, 50])
def test_periodic_runs(monkeypatch, probes):
    monkeypatch.setattr(periods, "PROBES", probes)
    import pyarrow as pa

    rows = period_rows()
    rows = rows if probes > 100 else [r for r in rows if len(r[1] or "") < 3000]
    seen = 0
    for k, found, text in periods._runs_of(pa.array([t for _, t in rows]), 12):
        w = re.findall(r"[^\x20\x09-\x0D]+", rows[k][1] or "")
        want = brute_runs(w)
        assert [tuple(r) for r in found] == want, rows[k]
        assert text.decode() == collapsed(w, want)
        seen += len(want)
    assert seen > 300


def test_runs_and_collapse(spark):
    rows = period_rows()
    docs = frame(spark, rows)
    want = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = brute_runs(w)
        want[i, tuple(r), collapsed(w, r), collapsed(w, r) if r else t] += 1
    got = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in periods.runs(docs).collect())
    assert got == Counter({k[:3]: n for k, n in want.items()})
    clean = periods.collapse(docs)
    assert clean.columns == docs.columns and Counter((r.doc_id, r.text) for r in clean.collect()) == Counter({(k[0], k[3]): n for k, n in want.items()})
    assert all(r._own == f"_own{r.doc_id}" and r.n_chars == (None if r.text is None else len(r.text)) for r in clean.collect())
    assert periods.runs(frame(spark, [])).count() == 0 and periods.collapse(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(np.zeros(0, np.uint64), np.zeros(1, np.int64), 5)


def test_runs_of_the_test_table(spark):
    """op13 over every document of sf0.001, told anew from its contract."""
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in queries.op13_periods(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        r = brute_runs(w)
        s, m, p = min(r, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert tuple(got[i]) == (i, len(r), s, m, p, 1000 * m // p if m else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in r)), sha(collapsed(w, r)))
    assert queries.repeating(frame(spark, [(None, "a b"), (5, None)])).filter(F.col("text") == "a b").count() == 1
