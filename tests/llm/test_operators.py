"""The corpus operators against brute force, on texts with nulls, copies, very long and empty ones."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from ridgeline.llm import ann, bpe, fingerprint, mixture, neardup, pii, quality, repeats, shard, warc

#: Extra columns with names that the operators use inside.
EXTRA = ("size", "label", "key", "_doc", "_id", "_text", "_th", "id", "th", "_email", "_terms", "_m", "_any", "_all", "mix_key", "_hash", "_bucket", "copies", "comp", "shard", "rk", "t")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def texts():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage = some(120), some(70)
    out = [None, "", "   \n\t", "one", "Two words", some(3), "x" * 3000, "ab" * 700, some(40_000)]
    out += [base] * 4 + [passage + " " + some(60), some(50) + " " + passage, passage + passage]
    for _ in range(30):  # a family of near copies
        words = base.split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
    out += [some(rng.randint(5, 200)) for _ in range(40)]
    out += ["mail a.b@c-d.example.org, a@b@c.d x@y", "ip 1.2.3.4.5.6.7.8 and 300.1.1.1 or 0001.2.3.255", "card 4111 1111 1111 1111 4111-1111-1111-1112 " + "4" * 5000, "+49 (30) 1234-567 +1 2 + 3 +123456789012345678"]
    out += ["@" * 50 + "a" * 20_000 + "@b.c", "𝒳𝒴 emoji 😀😀 don't we'll  trailing   "]
    return out


@pytest.fixture(scope="module")
def table():
    rows = [(i, t, "xx", None if i % 7 == 0 else f"s{i % 5}", None, *(f"{c}{i}" for c in EXTRA)) for i, t in enumerate(texts())]
    return [*rows, rows[9]]  # one repeated row


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def thue_morse(n: int) -> tuple[str, str]:
    """A Thue-Morse word of 2**n letters and its complement, which polynomial hashes modulo 2**64 do not tell apart."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def test_repeats(docs, none, table):
    raw = [(r[0], (r[1] or "").encode()) for r in table]
    count = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = set()
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        want.add((i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(table) and {tuple(r) for r in got} == want
    assert repeats.remove_repeats(none).count() == 0


@pytest.mark.parametrize("most", [1, 2, 5])
def test_repeats_of_large_groups(docs, monkeypatch, most):
    want = sorted(map(tuple, repeats.remove_repeats(docs).collect()))
    monkeypatch.setattr(repeats, "MAX_GROUP", most)
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect())) == want


@pytest.mark.parametrize("most", [20_000, 3])
def test_repeat_groups(docs, none, table, monkeypatch, most):
    monkeypatch.setattr(repeats, "MAX_GROUP", most)
    raw = {r[0]: (r[1] or "").encode() for r in table}
    groups: dict = {}
    for r in repeats.repeat_groups(docs).collect():
        groups.setdefault((r.repeat_id, r["size"]), set()).add((r.doc_id, r.start))
    at: dict = {}
    for (name, size), found in groups.items():
        assert size >= 200 and len({raw[i][k : k + size] for i, k in found}) == 1  # sound
        for i, k in found:
            at.setdefault(i, []).append((k, size, found))
    windows: dict = {}
    for i, b in raw.items():
        for k in range(len(b) - 199):
            windows.setdefault(b[k : k + 200], []).append((i, k))
    some = [w for w in windows.values() if len(w) > 1]
    assert some
    for w in some:  # whole: all occurrences of a window that recurs are within one group
        i, k = w[0]
        assert any(lo <= k and k + 200 <= lo + size and all((j, m - k + lo) in found for j, m in w) for lo, size, found in at[i])
    assert repeats.repeat_groups(none).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "l") for i in range(300)]
    rows += [(300, None, "l"), (301, [0.0] * 8, "l"), (302, [1.0, None] + [0.0] * 6, "l"), (303, [float("nan")] * 8, "l"), (304, [1.0] * 3, "l"), (None, [1.0] * 8, "l")]
    rows += [(i, [2.0] * 8, "l") for i in range(305, 345)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string")
    got = ann.search(df, df.filter("vec_id % 20 = 0"), k=20, n_lists=6, probes=None, rerank=345).collect()
    x = {i: np.array(np.float32(v), float) for i, v, _ in rows if i is not None and (i < 300 or i >= 305)}
    for q in (i for i in x if i % 20 == 0):
        want = sorted((-(v * x[q]).sum(), i) for i, v in x.items() if i != q)[:20]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [w[1] for w in want] and np.allclose([m[2] for m in mine], [-w[0] for w in want])
    hidden = [*((i, [-9.0] * 7 + [1.0], "l") for i in range(1000, 1200)), *((i, [9.0] * 8, "l") for i in range(2000, 2004))]  # lists of few rows
    hidden = spark.createDataFrame(hidden, "vec_id long, embedding array<float>, list string")
    assert ann.search(hidden, hidden.filter("vec_id = 2000"), n_lists=2, probes=1).count() == 20
    few = df.filter("vec_id < 5")
    assert ann.search(few, few.filter("vec_id = 0")).count() == 4
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_ann_of_several_lengths(spark):
    """Each length of vectors is searched by itself, exactly; rows repeat, and extra columns bear working names."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8 if i % 3 else 5)]) for i in range(200)] + [(201, [1.0]), (220, [2.0]), (222, [-1.0]), (240, []), (260, [float("inf")] * 8)]
    rows += [rows[20]] * 3
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], "vec_id long, embedding array<float>, id string, vec string, code string")
    got = ann.search(df, df.filter("vec_id % 20 = 0"), n_lists=4, probes=None, rerank=300).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = [(i, np.array(np.float32(v), float)) for i, v in rows if v and np.isfinite(v).all()]
    for q, v in {i: v for i, v in x if i % 20 == 0}.items():
        want = sorted((-(w * v).sum(), i) for i, w in x if i != q and len(w) == len(v))[:20]
        assert [i for _, i, _ in sorted(found.pop(q))] == [i for _, i in want]
    assert not found


def test_ann_recall_at_its_defaults(spark):
    """The production setting against brute force over all rows."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = vectors.filter("vec_id % 20 = 0")
    got = ann.recall(vectors, queries, ann.search(vectors, queries)).collect()
    assert len(got) == queries.count() and np.mean([r.recall for r in got]) >= 0.9


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fine(kind: str, m: str) -> bool:
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii(docs, none, table):
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i, t, *_ in table:
        if t and len(t) > 100_000:
            continue
        quick = (t or "") if "a" * 20_000 not in (t or "") else None  # the plain pattern is quadratic there
        if quick is not None:
            spans = [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, quick) if fine(k, m.group())]
            assert got[i].base_sha256 == sha(",".join(spans).encode()), (i, spans)
            assert got[i].spans.startswith(",".join(spans))
    assert pii.find(none).count() == 0 and pii.sanitize(none).count() == 0
    clean = pii.sanitize(docs)
    assert clean.columns == docs.columns and clean.count() == len(table)
    assert all(r[c] == f"{c}{r.doc_id}" for r in clean.collect() for c in EXTRA)
    texts_ = {r.doc_id: r.text for r in clean.collect()}
    assert texts_[0] is None and "[EMAIL]" in next(t for t in texts_.values() if t and t.startswith("mail"))


def test_pii_disclosure(spark):
    """PMI / IC by brute force over documents: words of the lines near each value, outside of addresses."""
    rng = random.Random(4)
    names, mails = ["quix", "zorb", "fenn", "mull", "rask"], [f"u{k}@mail.example.org" for k in range(5)]
    rows = []
    for i in range(120):
        k = rng.randrange(5)
        lines = [" ".join(rng.choices(["note", "about", "work", "and", "rest", *names[:2]], k=6)) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.6:
            lines.insert(rng.randint(0, len(lines)), f"ask {names[k]} or {rng.choice(names)}: {mails[k]}")
        rows.append((i, "\n".join(lines)))
    n, near, entity, term = len(rows), Counter(), Counter(), Counter()
    words = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]+", re.sub(BASE["email"], " ", t))}
    for _, t in rows:
        lines = t.split("\n")
        term.update(words(t))
        pairs = set()
        for k, line in enumerate(lines):
            for m in re.finditer(BASE["email"], line):
                pairs |= {(m.group(), w) for w in words("\n".join(lines[max(0, k - 3) : k + 4]))} | {(m.group(), None)}
        entity.update(e for e, w in pairs if w is None)
        near.update(p for p in pairs if p[1])
    want: dict = {}
    for (e, w), both in near.items():
        if both >= 3 and entity[e] >= 3:
            want[w] = max(want.get(w, 0), 1 + np.log(min(1, both / term[w])) / np.log(n / entity[e]))
    for least in (0.3, 0.6, 0.9):
        got = {r.term: r.disclosure for r in pii.revealing_terms(spark.createDataFrame(rows, "doc_id long, text string"), disclosure=least).collect()}
        mine = {w: d for w, d in want.items() if d >= least}
        assert got.keys() == mine.keys() and all(abs(got[w] - mine[w]) < 1e-9 for w in got) and (got or least > 0.5)


def test_pii_terms(spark):
    rows = [(i, f"call zorblax now {i} at z@corp.example.com") for i in range(6)] + [(10 + i, "call me now at noon") for i in range(40)] + [(99, "who is Zorblax?")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert got[99].spans == "term:7:14" and got[0].n_term == 1 and got[10].spans == ""
    assert "lorblax" not in pii.sanitize(df).filter("doc_id = 99").first().text.lower()


def test_pii_of_repeated_rows(spark):
    """Documents counted once however often a row stands: the terms, by brute force over the distinct rows."""
    rng = random.Random(8)
    rows = [(i, f"call zorblax or {rng.choice('abc')}quix now {i} at z@corp.example.com") for i in range(6)] + [(10 + i, "call me now at noon") for i in range(40)] + [(99, "who is Zorblax?")]
    rows += [(3, "another text of id 3 by Zorblax")]  # an id of two documents
    told = lambda rs, **k: {(r.term, r.kind): round(r.disclosure, 12) for r in pii.revealing_terms(spark.createDataFrame(rs, "doc_id long, text string"), disclosure=0.0, **k).collect()}
    once = told(rows)
    assert ("zorblax", "email") in once and told(rows * 3) == once and told(rows + rows[:4] * 7 + rows[20:30] * 2) == once
    near = {w for i, t in rows[:6] for w in re.findall(r"[^\W\d_]+", re.sub(BASE["email"], " ", t).lower())}
    n, has = len(rows), {w: sum(w in re.findall(r"[^\W\d_]+", re.sub(BASE["email"], " ", t).lower()) for _, t in rows) for w in near}
    both = {w: sum(w in re.findall(r"[^\W\d_]+", re.sub(BASE["email"], " ", t).lower()) for _, t in rows[:6]) for w in near}
    want = {(w, "email"): round(1 + np.log(both[w] / has[w]) / np.log(n / 6), 12) for w in near if both[w] >= 3}
    assert once.keys() == {k for k, v in want.items() if v >= 0} and all(abs(once[k] - want[k]) < 1e-9 for k in once)
    thrice = spark.createDataFrame(rows[:-1] * 3, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(thrice).collect()}
    assert got[99] == "term:7:14" and "zorblax" not in pii.sanitize(thrice).filter("doc_id = 99").first().text.lower()


def test_pii_window(spark):
    far = "\n".join(["z@corp.example.com", *["."] * 5, "Zorblax"])
    rows = [(i, f"{i}\n{far}") for i in range(6)] + [(10 + i, "other words") for i in range(40)] + [(99, "Zorblax")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    last = lambda **k: {r.doc_id: r.spans for r in pii.find(df, **k).collect()}[99]
    assert (last(), last(window=5), last(window=6), last(window=None)) == ("", "", "term:0:7", "term:0:7")


def test_pii_names_beside_their_address(spark):
    rows = [(i, f"note {i} from Jane Doe <jane.doe@acme.org> of Acme") for i in range(6)] + [(10 + i, f"a note {i} of another kind from us") for i in range(40)]
    rows += [(98, "jane.doe@acme.org"), (99, "ask Jane or Mr Doe at Acme")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert got[99].spans == "term:4:8,term:15:18,term:22:26" and got[10].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitize(df).collect()}
    assert clean[99] == "ask  or Mr  at " and clean[98] == "[EMAIL]" and clean[0] == "note 0 from   <[EMAIL]> of "


def test_pii_of_copied_and_neighbouring_lines(spark):
    copied = "contact Zorblax at z@corp.example.org"  # word for word the same line in each document
    block = "Best wishes\nQuix Li\nHead of Sales\nq@corp.example.org\nBrumwick"  # a name above the address and a place below
    rows = [(i, f"note {i}\n{copied}\nend") for i in range(6)] + [(10 + i, f"far word{i}\n.\n.\n{block}") for i in range(6)]
    rows += [(20 + i, "contact best wishes head of sales at note end far word") for i in range(60)] + [(99, "Zorblax Quix Li Brumwick far")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert got[99].spans == "term:0:7,term:8:12,term:13:15,term:16:24" and got[20].spans == ""


def test_warc(spark):
    big = "<p>é</p>" * 400
    rows = [(1, "u1", None), (2, None, ""), (3, "u3", "small"), (4, "u4", "small"), (5, "u5", big), (9, "u\r\n9", big), (7, "u7", big), (9, "u9", big), (10_000, "x", "y" * 3_000_000), (None, "n", "z" * 2000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, shard int")
    got = warc.round_trip(pages, payloads=True).collect()
    assert len(got) == len(rows)
    body = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        b = body[r.page_id]
        assert r.payload_bytes == len(b) and r.payload_digest == hashlib.sha1(b).hexdigest()
        assert (r.payload == b) if r.record_type == "response" else (r.payload is None and r.refers_to == 9 and b == big.encode())
    assert sorted(r.page_id for r in got if r.record_type == "revisit") == [5, 7, 9]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_is_deterministic_and_checked(spark, tmp_path):
    rows = [(i if i % 3 else 7, f"u{i}", f"page {i} " * (1 + i % 90)) for i in range(900)]  # a third of the rows under one id
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for k, n in ((0, 1), (1, 7)):
        to = f"file://{tmp_path}/{k}"
        warc.pa.fs.FileSystem.from_uri(f"file://{tmp_path}")[0].create_dir(f"{tmp_path}/{k}/shard-0-0", recursive=True)
        (tmp_path / str(k) / "shard-0-0" / ".00000.lost.tmp").write_bytes(b"of a lost executor")
        done = warc.write(warc.plan_records(pages.repartition(n), shard_bytes=20_000), to, roll_bytes=5000)
        found.append(sorted((r.name, r.records, r.sha256) for r in done.collect()))
        assert warc.read(spark, done, to).count() == len(rows)
        names = sorted(str(p.relative_to(tmp_path / str(k))) for p in (tmp_path / str(k)).rglob("*") if p.is_file() and "manifest" not in str(p) and not p.name.endswith(".crc"))
        assert names == [f[0] for f in found[-1]] and max(p.stat().st_size for p in (tmp_path / str(k)).rglob("*.gz")) < 6000
    assert found[0] == found[1] and len({n.split("/")[0] for n, *_ in found[0]}) > 5
    path = tmp_path / "1" / found[1][0][0]
    path.write_bytes(path.read_bytes() + path.read_bytes())
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, done, to).collect()


def test_mixture(docs, none, table):
    got = mixture.mix(docs).collect()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in table}
    assert len(got) == len(table) and all(r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] for r in got)
    own: Counter = Counter()
    for r in table:
        own[r[3]] += size[r[0]]
    names = sorted((s for s in own if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(own.values()))
    while True:  # water-filling by its definition
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * own[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * own[s]
            open_.remove(s)
            rest -= target[s]
    for s in names:
        mine = [r for r in got if r.source == s]
        assert abs(mine[0].target - target[s]) < 1e-6 * max(1, target[s]) and mine[0].source_size == own[s]
        small = min((r["size"] for r in mine if r["size"]), default=0)
        assert target[s] - max(r["size"] for r in mine) <= sum(r.taken for r in mine) <= target[s] + small + 1
    assert sorted(map(str, got)) == sorted(map(str, mixture.mix(docs).collect()))
    assert mixture.mix(none).count() == 0 and mixture.mix_documents(none).count() == 0
    out = mixture.mix_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got if r["size"])


def drawn(key, tree, seed=6):
    """The descent by its definition."""

    def least(level, weights):
        h = lambda v, s: xxhash.xxh64_intdigest(v.to_bytes(4, "little", signed=True), seed=s)
        u = lambda node: ((h(node, h(level, h(seed, xxhash.xxh64_intdigest(key.to_bytes(8, "little"), seed=42)))) >> 11) + 0.5) * 2.0**-53
        return min((-np.log(u(node)) / w, node) for node, w in weights.items())[1]

    region = least(0, {r: sum(w for k in inner.values() for w in k.values()) for r, inner in tree.items()})
    rack = least(1, {k: sum(s.values()) for k, s in tree[region].items()})
    return region, rack, least(2, tree[region][rack])


def test_sharding(docs, none, table):
    got = shard.shard_documents(docs).collect()
    tree, text = shard.topology(24), {r[0]: (r[1] or "").encode() for r in table}
    for r in got:
        assert (r.region, r.rack, r.shard) == drawn(r.doc_id, tree)
        assert r.grown_shard == drawn(r.doc_id, shard.grow(tree))[2] and r.grown_shard in (r.shard, 24)
        assert r["size"] == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id])
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len(got) == len(table) and shard.shard_documents(none).count() == 0


def test_sharding_moves_only_within_changed_subtrees(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "k")
    place = lambda tree: [tuple(r)[1:] for r in shard.descend(ids, ids.k, tree).orderBy("k").collect()]
    before, after = place(shard.topology(24)), place(shard.topology(24, weights={7: 4.0}))  # shard 7: rack 1, region 1
    moved = [(a, b) for a, b in zip(before, after, strict=True) if a != b]
    for (region, rack, _), (to_region, to_rack, to_shard) in moved:
        assert to_region == 1  # the region that grew
        assert region != 1 or to_rack == 1  # within it, the rack that grew
        assert (region, rack) != (1, 1) or to_shard == 7  # within that, the shard
    assert abs(sum(a[2] == 7 for a in after) / 20_000 - 4 / 27) < 0.02
    grown = place(shard.grow(shard.topology(24)))
    assert all(a == b or b[2] == 24 for a, b in zip(before, grown, strict=True)) and abs(sum(b[2] == 24 for b in grown) / 20_000 - 1 / 25) < 0.01
    count = Counter(a[2] for a in before)
    assert max(count.values()) < 1.2 * min(count.values())


def test_fingerprints(docs, none, table):
    got = fingerprint.fingerprint_pairs(docs).collect()
    order = sorted(((r[0], r[1] or "") for r in table), reverse=True)
    want = Counter()
    for k, (i, t) in enumerate(order):
        n, after = len(t), order[(k + 1) % len(order)][1]
        want[(i, n, sha((t[: n - n // 2] + after[: n // 2]).encode()))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    text = dict(order)
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.split()] if w for k in range(max(1, len(w) - 4))}
    for r in got:
        k = [i for i, _ in order].index(r.doc_id)
        a, b = shingles(text[r.doc_id]), shingles(order[(k + 1) % len(order)][1])
        if r.doc_id != 9:  # the repeated row
            assert abs(r.near_next - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
        edited = text[r.doc_id][: r.n_chars - r.n_chars // 2] + order[(k + 1) % len(order)][1][: r.n_chars // 2]
        if r.doc_id != 9:
            assert r.edited_sha256 == sha(edited.encode())
            (sig,), (has,) = fingerprint.text_signatures([edited])
            assert r.edited_fingerprint == (sig.tobytes().hex() if has else "")
            b = shingles(edited)
            assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    a, b = fingerprint.text_signatures([*thue_morse(10)])[0]
    assert (a != b).any()
    assert len({(r.fingerprint, text[r.doc_id]) for r in got}) == len({text[r.doc_id] for r in got})
    assert fingerprint.fingerprint_pairs(none).count() == 0


def test_quality(spark, docs, none):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choices(["the", "quiet", "house", "stood", "near", "water."], k=60))) for i in range(200)]
    bad = [(1000 + i, " ".join(rng.choices(["WIN!!", "$$$", "CLICK***"], k=60))) for i in range(200)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == (r.doc_id < 1000) for r in got if r.held_out]) > 0.97
    assert quality.classify(docs, labels).count() == docs.count() and quality.classify(none, labels.limit(0)).count() == 0


def test_quality_on_held_out_documents(spark):
    """Labels of the test table: how often a held-out document of label 1 scores above one of label 0, and accuracy."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).filter("held_out").join(labels, "doc_id").filter("quality IS NOT NULL").collect()
    good, bad = (np.array([r.score for r in got if r.quality == y]) for y in (1, 0))
    assert len(good) > 100 and len(bad) > 30
    assert (good[:, None] > bad[None, :]).mean() > 0.99 and np.mean([r.predicted == r.quality for r in got]) > 0.97


def test_byte_bpe(docs, none, table):
    import public_tokenizers as public
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_decode(docs, digests=True).collect():
        text = next(t[1] for t in table if t[0] == r.doc_id) or ""
        if "a" * 20_000 not in text:  # the plain library takes quadratic time there
            assert list(r.ids) == enc.encode_ordinary(text)
        assert r.n_tokens == len(r.ids) and bytes(r.decoded) == text.encode() and r.decoded_sha256 == sha(text.encode())
        assert r.ids_sha256 == sha(np.array(r.ids, "<u4").tobytes())
    assert bpe.encode_decode(none).count() == 0


def test_byte_bpe_of_long_pieces(spark):
    import public_tokenizers as public
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    words = [w for w in (k.decode("utf8", "ignore").strip() for k in ranks) if w.isalpha()]
    some = [*thue_morse(10), *thue_morse(11), "a" * 5000, "ab" * 3000]
    some += ["".join(rng.choices(letters, k=n)) for letters in ("ab", "abc", "thein", "aeioustrn", "é日本ñ", "=-", "0123456789") for n in (513, 3000)]
    some += ["".join(rng.choices(words, k=300)) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(1)
    for r in bpe.encode_decode(df, digests=True).collect():
        assert list(r.ids) == enc.encode_ordinary(some[r.doc_id]) and bytes(r.decoded) == some[r.doc_id].encode()


def brute_components(table, size):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    top = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top[i], top[j]))
                top = {k: a if v == b else v for k, v in top.items()}
    return sets, top


def test_near_duplicates(docs, none, table):
    sets, top = brute_components(table, 4)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(table)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top[r.doc_id], r.doc_id == top[r.doc_id])
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(docs)
    _, top = brute_components(table, 5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(top.values())) and kept.columns == docs.columns
    assert neardup.keep_one(none).count() == 0


def test_near_duplicates_of_regular_words(spark):
    rows = [(i, f"{w} {v}") for i, (w, v) in enumerate((w, v) for w in thue_morse(10) for v in thue_morse(11))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    assert all(r.kept and r.n_shingles == 1 for r in got)
    words = [" ".join(f"w{c}" for c in w) for w in thue_morse(10)]
    got = neardup.sets(*next((d, o) for _, _, d, o in neardup.text_slices(neardup.pa.array(words), 1 << 20)), 1024)[0]
    assert got[0] != got[1]


def test_near_duplicates_in_large_buckets(docs, monkeypatch):
    want = sorted(map(tuple, neardup.near_duplicates(docs).collect()))
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "LARGE", 4)
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == want


@pytest.mark.parametrize("alike", [0, 1, 2, 3, 4, 6])
def test_pairs_of_large_buckets_are_whole(alike):
    """A bucket of 700 rows that agree in some chunks, default constants: no pair within DISTANCE is lost, wherever its
    components differ."""
    rng = np.random.default_rng(alike)
    sig = rng.integers(0, 2**16, (700, neardup.COMPONENTS), dtype=np.uint16)
    sig[:, : alike * neardup.WIDTH] = sig[0, : alike * neardup.WIDTH]
    n, comp, sketch = np.full(700, 100_000), np.arange(700), np.zeros((700, neardup.SKETCH), np.uint8)
    free, pairs = np.arange(alike * neardup.WIDTH, neardup.COMPONENTS), []
    for k in range(300):
        a, b = 2 * k, 2 * k + 1
        sig[b] = sig[a]
        most = min(neardup.DISTANCE, len(free))
        if k % 2:  # evenly over the chunks, where the pigeonhole holds least
            places = np.concatenate([free[j :: neardup.WIDTH] for j in range(neardup.WIDTH)])[: most - k % 4]
        else:
            places = rng.choice(free, most, replace=False)
        sig[b, places] += np.uint16(1)
        pairs.append((a, b))
    found = {tuple(sorted(p)) for x, y in neardup._large_pairs(np.arange(700), sig, comp, n, sketch, 80) for p in zip(x.tolist(), y.tolist())}
    assert set(pairs) <= found


def test_near_duplicates_of_the_test_table(spark):
    """All links of sf0.01 by brute force over all pairs with a shingle in common: none is lost, none is made up."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, holders = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    both = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()} and len({c for _, c in got.values()}) < len(rows)


def test_near_duplicates_in_small_blocks(docs, monkeypatch):
    want = sorted(map(tuple, neardup.near_duplicates(docs).collect()))
    monkeypatch.setattr(neardup, "BLOCK", 5)
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == want


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of exactly 80 per cent: nested sets of 4 of 5, 8 of 10 and 16 of 20 shingles, and equal sizes that differ on both sides."""
    for size, method in ((4, neardup.near_duplicates), (5, neardup.near_duplicates), (5, neardup.keep_one)):
        rows, i = [], 0
        for shared, total in ((4, 5), (8, 10), (16, 20)):
            for both in (False, True):
                for k in range(12):
                    m = total - shared
                    words = [f"w{shared}x{both:d}x{k}x{j}" for j in range(total + size - 1)]
                    cut = m // 2 if both else 0
                    pair = words[: len(words) - m + cut], words[cut:]
                    rows += [(i + d, " ".join(t)) for d, t in enumerate(pair)]
                    i += 2
        _, top = brute_components(rows, size)
        assert all(top[k] == k - k % 2 for k in top)
        got = method(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()
        if method is neardup.keep_one:
            assert sorted(r.doc_id for r in got) == sorted(set(top.values()))
        else:
            assert {r.doc_id: r.component_id for r in got} == top


def test_pipeline(spark, docs, none, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i > 8), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, none):
        rows = start
        for name, stage in pipeline.STAGES:
            before, rows = rows, stage(spark, rows, str(tmp_path))
            if name != pipeline.STAGES[-1][0]:
                assert rows.columns == docs.columns, name
                assert before.count() >= rows.count() or name.startswith("mixing")
        assert (rows.count() > 0) == (start is docs)
    assert pipeline.run(spark, str(tmp_path)).count() > 0
