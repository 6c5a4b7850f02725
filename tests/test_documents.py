"""Document operators on small inputs, against plain versions."""

import random
import re

import pytest

from ridgeline.functions import cues as cu
from ridgeline.operators import closures
from ridgeline.operators import documents as dc
from ridgeline.plans import documents as plans
from ridgeline.sources import releases


def plain_chunks(text, target):
    blocks, cur, heading, scale, before = [], [], None, None, []
    for line in re.split(r"\r\n|\r|\n", text):
        if not line.strip():
            if cur:
                blocks.append(cur)
            cur = []
            continue
        if not cur:
            before.append((heading, scale))
        if re.match(r"^#{1,6}\s+\S", line):
            heading = line.strip()
        found = re.search(r"\((?:in\s+|en\s+)?(?:\$?\s*000s?|thousands|milliers|millions)[^)]*\)", line, re.I)
        scale = found.group(0) if found else scale
        cur.append(line)
    if cur:
        blocks.append(cur)
    chunks, held = [], []
    for k, b in enumerate(blocks):
        if held and len(held) + len(b) > target:
            chunks.append((first, held))
            held = []
        if held:
            held = [*held, "", *b]
        else:
            first, held = before[k], list(b)
    if held:
        chunks.append((first, held))
    return [(h, s, len(c), "\n".join(c)) for (h, s), c in chunks]


def test_context_chunks(spark):
    rng = random.Random(3)
    lines = ["a line", "", "  ", "# One", "## Two more ", "#no heading", "cost (in thousands of dollars) and (millions)", "($000s) x", "(En Milliers)", "(in millions", "####### seven", "end  "]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(0, 40))) for _ in range(120)] + ["", "   ", "\n\n", "x", "\r\na\r\n\r\nb\rc", "# H\n\n" + "row\n" * 60, "\n".join(f"p{k}\n" for k in range(300))]
    rows = [*enumerate(texts), (999, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    for target in (1, 5, 12):
        got = {}
        for r in dc.context_chunks(df, "id", "text", target).orderBy("id", "chunk").collect():
            got.setdefault(r.id, []).append((r.heading, r.scale, r.lines, r.body))
            assert r.lines == r.body.count("\n") + 1 and (r.lines <= target + 1 or "\n\n" not in r.body)
            assert (r.context == "") == (r.heading is None and r.scale is None) and (r.heading is None or f'section: "{r.heading}"' in r.context)
        assert got == {i: c for i, t in rows if t and (c := plain_chunks(t, target))}


def test_cue_hits(spark):
    rng = random.Random(4)
    cues = ["a", "ab", "abc", "b.c", "aa", "cab", "(x", "é", "b c", "bb", "AB".lower(), "abcabc"]
    rows = [(k, "".join(rng.choices("abcABé. (x", k=rng.randint(0, 80)))) for k in range(150)] + [(900, None), (901, "")]
    got = {(r.id, r.cue): r.hits for r in dc.cue_hits(spark.createDataFrame(rows, "id long, text string"), ["id"], cu.F.col("text"), cues).collect()}
    assert got == {(i, c): n for i, t in rows for c in set(cues) if (n := (t or "").lower().count(c))}
    assert dc.cue_hits(spark.createDataFrame(rows[:1], "id long, text string"), ["id"], cu.F.col("text"), []).count() == 0
    assert len(dc.METRIC_CUES) == 60 and [c for c in ("ee", "employee", "trip") if cu.overlaps_itself(c)] == ["ee", "employee"]


def plain_selection(scores, most, head=3):
    if len(scores) <= most:
        return list(range(len(scores)))
    front = list(range(min(head, most)))
    rest = [(s, i) for i, s in enumerate(scores) if i not in front]
    rest = [x for x in rest if x[0] > 0] or rest
    return sorted(front + [i for _, i in sorted(rest, key=lambda x: (-x[0], x[1]))[: most - len(front)]])


def test_page_selection(spark):
    rng = random.Random(5)
    docs = {k: [rng.choice([0, 0, 3, 5, 9]) if k % 4 else 0 for _ in range(rng.randint(1, 14))] for k in range(40)}
    df = spark.createDataFrame([(k, i, s) for k, v in docs.items() for i, s in enumerate(v)], "doc long, page long, score long")
    for most in (2, 5, 8):
        got = {}
        for r in dc.select_pages(df, "doc", "page", most).orderBy("doc", "place").collect():
            got.setdefault(r.doc, []).append(r.page)
        assert got == {k: plain_selection(v, most) for k, v in docs.items()}


def plain_windows(sizes, most_pages, most_bytes):
    def emit(start, n):
        if sum(sizes[start : start + n]) > most_bytes and n > 1:
            return emit(start, n // 2) + emit(start + n // 2, n - n // 2)
        return [(start, n)]

    return [w for s in range(0, len(sizes), most_pages) for w in emit(s, min(most_pages, len(sizes) - s))]


def test_page_windows(spark):
    rng = random.Random(6)
    docs = {k: [rng.choice([1, 5, 60, 400]) for _ in range(rng.randint(1, 40))] for k in range(30)}
    df = spark.createDataFrame([(k, i, s) for k, v in docs.items() for i, s in enumerate(v)], "doc long, page long, size long")
    got = {}
    for r in dc.page_windows(df, "doc", "page", "size", most_pages=13, most_bytes=300).collect():
        assert r.first <= r.page < r.first + r.n_pages and r.n_bytes == sum(docs[r.doc][r.first : r.first + r.n_pages])
        got.setdefault(r.doc, set()).add((r.first, r.n_pages))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_windows(v, 13, 300) for k, v in docs.items()}


@pytest.mark.parametrize("batch, overlap", [(5, 0), (5, 2), (4, 3), (3, 7), (1, 0)])
def test_sliding_batches(spark, batch, overlap):
    docs = {d: list(range(0, 3 * n, 3)) for d, n in enumerate([1, 2, 4, 5, 6, 8, 9, 17])}
    df = spark.createDataFrame([(d, p) for d, ps in docs.items() for p in ps], "doc long, page long")
    got = {}
    for r in dc.sliding_batches(df, "doc", "page", cu.F.floor(cu.F.col("page") / 8), batch, overlap).orderBy("page").collect():
        got.setdefault((r.doc, r.batch_no), []).append(r.page)
    want = {}
    for d, pages in docs.items():
        i = k = 0
        while True:
            want[d, k] = pages[i : i + batch]
            if i + batch >= len(pages):
                break
            i, k = i + max(1, batch - overlap), k + 1
    assert got == want


def test_file_rules_and_catalog(spark):
    rules = spark.createDataFrame([("ab", "x", "short"), ("ab-c", "y", "long"), ("z", "nobody", "z")], "prefix string, agency string, kind string")
    exact = spark.createDataFrame([("ab-c-2020", "x", "exact")], "stem string, agency string, kind string")
    names = ["ab-2019.pdf", "ab-c-1999.PDF", "ab-c-2020.pdf", "ab-c.pdf", "q-2001.pdf", "z-2001.pdf", "ab-1899-2105-2003.pdf"]
    files = spark.createDataFrame([(n, f"h{k}", k) for k, n in enumerate(names)], "file_name string, file_hash string, file_bytes int")
    specs = dc.file_specs(files, rules, exact)
    got = {r.file_name: (r.agency, r.kind, r.year, r.skipped) for r in specs.collect()}
    assert got == {
        "ab-2019.pdf": ("x", "short", 2019, None), "ab-c-1999.PDF": ("y", "long", 1999, None), "ab-c-2020.pdf": ("x", "exact", 2020, None), "ab-c.pdf": (None, None, None, "no launch year in name"),
        "q-2001.pdf": (None, None, 2001, "no rule for name"), "z-2001.pdf": ("nobody", "z", 2001, None), "ab-1899-2105-2003.pdf": ("x", "short", 2003, None),
    }
    catalog = spark.createDataFrame([("x/ab-2019.pdf", "x", 2019, "old", 1, "scanned"), ("x/gone-2000.pdf", "x", 2000, "g", 1, "failed")], "storage_key string, agency string, year int, file_hash string, file_bytes int, scan_status string")
    agencies = spark.createDataFrame([("x",), ("y",)], "agency string")
    once = dc.sync_catalog(catalog, specs, agencies)
    got = {r.storage_key: (r.file_hash, r.scan_status, r.action) for r in once.collect()}
    assert got["x/ab-2019.pdf"] == ("h0", "scanned", "refreshed") and got["x/gone-2000.pdf"] == ("g", "failed", "kept") and got["y/ab-c-1999.PDF"] == ("h1", "pending", "inserted")
    assert got["z-2001.pdf"][2] == "skipped: agency not seeded: nobody" and got["ab-c.pdf"][2] == "skipped: no launch year in name"
    again = dc.sync_catalog(once.filter("scan_status IS NOT NULL").drop("action"), specs, agencies)
    assert {r.action for r in again.collect() if not r.action.startswith("skipped")} == {"kept", "unchanged"}


def test_distinct_slugs(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", "b-7", "a-3", "a-5", "c", "a-5-2"])) for i in range(1, 60)]
    taken = {"c", "a", "b-9", "b-9-2"}
    used, want = set(taken), {}
    for i, base in rows:
        k = 0
        while (s := base if k == 0 else f"{base}-{i}" if k == 1 else f"{base}-{i}-{k}") in used:
            k += 1
        used.add(s)
        want[i] = s
    df, held = spark.createDataFrame(rows, "id long, base string"), spark.createDataFrame([(t,) for t in taken], "slug string")
    assert {r.id: r.slug for r in closures.distinct_slugs(df, held, "id").collect()} == want
    assert closures.distinct_slugs(df.limit(0), held, "id").count() == 0


def test_lineage_closure(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(12)] + [(1, 2), (1, 2), (None, 3), (4, None)]  # cycles and a chain
    df = spark.createDataFrame(edges, "value_id long, input_id long")
    want = {(a, b): 1 for a, b in edges if a is not None and b is not None}
    front, depth = dict(want), 1
    while front:
        depth += 1
        front = {(a, c): depth for a, b in front for x, c in edges if x == b and c is not None and (a, c) not in want}
        want |= front
    got = closures.lineage_closure(df).collect()
    assert {(r.value_id, r.input_id): r.depth for r in got} == want and len(got) == len(want)
    assert want[100, 112] == 12 and closures.lineage_closure(df.limit(0)).count() == 0


def test_json_files(spark, tmp_path):
    for name, text in (("a", '{"slug": "s",\n "year": 2001,\n "cases": [{"id": 1, "value": 2.5}, {"id": 2}]}'), ("b", '{"slug": "t", "cases": []}'), ("c", '{"slug": "u", "cases": [{"id"'), ("d", "nothing")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "gold.json").write_text(text)
    rows, broken = releases.read_json_files(spark, f"{tmp_path}/*/gold.json", "slug string, year int, cases array<struct<id: bigint, value: double>>", "cases")
    assert sorted(((r.file, r.year, r.id, r.value) for r in rows.collect()), key=str) == [("a", 2001, 1, 2.5), ("a", 2001, 2, None), ("b", None, None, None)]
    assert sorted(r.file for r in broken.collect()) == ["c", "d"] and "id" in broken.filter("file = 'c'").first().text


def test_releases(spark, tmp_path, monkeypatch):
    store = releases.Releases(spark, f"file://{tmp_path}/r")
    rows = lambda n: spark.range(n).withColumn("v", cu.F.col("id") * 2)
    assert store.publish("one", {"a": rows(3), "b": rows(5)})["number"] == 1
    real = store._swap
    monkeypatch.setattr(store, "_swap", lambda m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):  # all tables are written, the manifest is not
        store.publish("two", {"a": rows(10), "b": rows(10)})
    monkeypatch.setattr(store, "_swap", real)
    other = releases.Releases(spark, f"file://{tmp_path}/r")
    assert (other.read("a").count(), other.read("b").count(), other.numbers()) == (3, 5, [1])
    failing = spark.range(4).withColumn("v", cu.F.expr("if(id = 3, raise_error('no'), id)"))
    with pytest.raises(Exception, match="no"):  # between two writes
        store.publish("two", {"a": rows(10), "b": failing})
    with pytest.raises(ValueError, match="least"):
        store.publish("two", {"a": rows(0)}, {"least": lambda t: t["a"].count() > 0 and t["b"].count() > 0})
    assert (other.read("a").count(), other.numbers()) == (3, [1])
    assert store.publish("two", {"a": rows(7)})["number"] == 2 and store.publish("two", {"a": rows(0)})["number"] == 2
    assert [(other.read("a", n).count(), other.read("b", n).count()) for n in (1, 2)] == [(3, 5), (7, 5)]
    monkeypatch.setattr(store, "numbers", lambda: [1])  # as a run that began before release 2 was there
    with pytest.raises(releases.Conflict):
        store.publish("late", {"a": rows(1)})
    monkeypatch.undo()
    assert other.read("a").count() == 7 and not [p for p in (tmp_path / "r" / "manifests").iterdir() if p.name.endswith(".tmp")]
    assert [(r.table, r.rows) for r in store.snapshot(f"file://{tmp_path}/copy").collect()] == [("a", 7), ("b", 5)]
    assert len(store.sweep(keep=2)) == 4 and other.read("b").count() == 5  # the runs that failed or were late
    assert releases.Releases(spark, f"file://{tmp_path}/copy").read("a").count() == 7


def test_context_chunks_of_odd_texts_match_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(5)
    odd = [*map(chr, (13, 9, 11, 12, 0x85, 0x2028, 0x2029, 0x2009, 0xA0, 0x3000, 28, 0, 0x1F600)), "\r\n", "(millions)", "($000s)", "(IN THOUSANDS)", "(in thousands", ")", "####### q", ""]
    parts = ["The cat. ", "Eau la vie", "a the b", "\n", "\n", "\n\n", "E", "Th", " la ", " ", "# x", "## ", "word", "(in thousands x)", ". "]
    texts = ["".join(rng.choice([*parts, o, o, o]) for _ in range(rng.randint(0, 40))) for o in odd for _ in range(20)]
    rows = [*enumerate(texts), (9_001, None), (9_002, ""), (None, "a\n\nb")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in plans.QUERIES["context_chunks"](spark, str(tmp_path)).collect()]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(c.execute(plans.SQL["context_chunks"]).fetchall(), key=str) and len(got) > 300
