"""SimHash, suffix arrays, spaced seeds, lines and mixing against brute force on small tables."""

import hashlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelattice.llm import decontam, lines, mixing, simhash, suffix
from tracelattice.llm.common import connected, hung, whole_text
from tracelattice.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edited(rng, text, changes):
    out = text.split(" ")
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    """(id, text) with exact copies, near copies and unlike texts."""
    rng, rows = random.Random(4), []
    for i in range(60):
        base = prose(rng, rng.randrange(3, 250))
        rows.append(base)
        rows += [base] * rng.choice((0, 0, 1)) + [edited(rng, base, rng.randrange(1, 5)) for _ in range(rng.choice((0, 0, 2)))]
    return list(enumerate(rows))


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [0, 4, 9])
def test_simhash_components(spark, copies, radius):
    marks = {}
    for i, t in copies:
        w = t.split()
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        marks[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    near = [(i, j) for i in marks for j in marks if i < j and (marks[i] ^ marks[j]).bit_count() <= radius]
    want = classes(marks, near)
    got = simhash.simhash_components(spark.createDataFrame(copies, "doc_id long, text string"), radius=radius).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{marks[i]:016x}", want[i]) for i in marks}


def test_hot_part_values_are_split(spark, copies, monkeypatch):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    want = {tuple(r) for r in simhash.simhash_components(docs).collect()}
    monkeypatch.setattr(simhash, "HOT_ROWS", 2)
    assert {tuple(r) for r in simhash.simhash_components(docs).collect()} == want


@pytest.mark.parametrize("radius", [0, 3, 4, 8])
def test_thresholds_keep_the_pigeonhole(radius):
    rng = np.random.default_rng(radius)
    x = (rng.random((500, 64)) < rng.random(64)).astype(float)
    groups, thresholds = simhash.search_plan(500, (x.T @ x).astype(int), radius)
    assert sorted(b for g in groups for b in g) == list(range(64)) and sum(thresholds) == radius - len(groups) + 1


def test_near_dedup(spark, copies):
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in copies}
    near = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    stay = set(classes(sets, near).values())
    got = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    assert got == stay


def test_copies_are_not_gathered(spark):
    """Many empty and many equal texts: no task sees more rows of a key than there are tasks before it, and one of each stays."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(100_000).selectExpr("id as doc_id", f"case id % 3 when 0 then '' when 1 then '{text}' end as text").repartition(6)
    texts = docs.select(F.xxhash64(whole_text()).alias("id"), whole_text().alias("text"))
    rows = simhash.prefixes(texts, 5, 0.8).groupBy("key", "salt").count()
    assert rows.agg(F.max("count")).first()[0] <= 6
    assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == [0, 1]


def near_classes(rows):
    """Smallest id of each class of texts with a Jaccard similarity of 0.8 or more, by brute force."""
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    near = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return set(classes(sets, near).values())


def test_near_dedup_checks_all_candidates_of_a_family(spark):
    rng, rows = random.Random(11), []
    for _ in range(30):  # the first is a candidate of both others, but no copy of them
        base = prose(rng, 200)
        rows += [edited(rng, base, 7), edited(rng, base, 1), edited(rng, base, 1)]
    rows = list(enumerate(rows))
    got = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_classes(rows)


def test_near_dedup_finds_cut_and_extended_copies(spark, monkeypatch):
    rng, rows = random.Random(12), []
    for i in range(150):  # a block of up to a fifth cut off, added or replaced; some words repeated often
        base = prose(rng, rng.randrange(60, 300), 12 if i % 3 == 0 else 400).split()
        k = int(len(base) * rng.uniform(0.07, 0.21))
        other = [f"y{rng.randrange(10**6)}" for _ in range(k)]
        rows += [" ".join(base), " ".join(rng.choice((base[:-k], base[k:], base + other, other + base, base[: -k // 2] + other[: k // 2])))]
    rows = list(enumerate([*rows, "", " ", "one", "one two"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_classes(rows[:-4]) | {300, 302, 303}  # texts without words are alike
    assert {r.doc_id for r in simhash.near_dedup(docs).collect()} == want
    usual = np.unique(np.concatenate([simhash.shingle_hashes(t.encode().split(), 5) for _, t in rows[::7]])).view(np.int64)
    usual.sort()  # any order of shingles gives the same rows
    monkeypatch.setattr(simhash, "usual_shingles", lambda texts, width: (usual, np.arange(len(usual)) % 5 + 1))
    assert {r.doc_id for r in simhash.near_dedup(docs).collect()} == want


def test_near_dedup_searches_fingerprints(spark, copies, monkeypatch):
    """Its candidates come from the pigeonhole search too, which connects the classes of op7 over five-word shingles."""
    rows = spark.createDataFrame(copies, "doc_id long, text string")
    texts = rows.select(F.xxhash64("text").alias("id"), "doc_id", "text")
    least = {r.id: r.low for r in texts.groupBy("id").agg(F.min("doc_id").alias("low")).collect()}
    pairs = [(least[r.a], least[r.b]) for r in simhash.probed(texts, 5, 4).collect()]
    want = {r.doc_id: r.component_id for r in simhash.simhash_components(rows, width=5, radius=4).collect()}
    assert pairs and classes(set(least.values()), pairs) == {i: want[i] for i in least.values()}
    asked, search = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: asked.append(a) or search(*a, **k))
    simhash.near_dedup(rows).collect()
    assert asked


def test_links_become_stars():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-200, 200, 250), rng.integers(-200, 200, 250)
    want = {i: r for i, r in classes(set(a.tolist()) | set(b.tolist()), list(zip(a.tolist(), b.tolist()))).items() if i != r}
    nodes, roots = hung(a, b)
    assert dict(zip(nodes.tolist(), roots.tolist())) == want and len(nodes) == len(want)


def test_connected(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)]
    want = classes({x for p in pairs for x in p}, pairs)
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in want.items() if x in got} and all(want[x] == x for x in want if x not in got)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(8)
    shared = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(30, 400))) for _ in range(6)]
    rows = []
    for i in range(40):
        own = ["".join(rng.choice("efghü ") for _ in range(rng.randrange(0, 120))) for _ in range(4)]
        rows.append((i % 30, "".join(x for o in own for x in (o, rng.choice(shared) if rng.random() < 0.5 else ""))))
    return [*rows, rows[3], (77, "no " * 300), (None, None), (78, "")]


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup(spark, passages, hot):
    length, texts = 64, [(d, (t or "").encode()) for d, t in passages]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    want = Counter()
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[d, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix.dedup_substrings(spark.createDataFrame(passages, "doc_id long, text string"), length, hot)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want


def test_maximal_repeats_are_left_diverse():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(60)).encode() for _ in range(5)]
    owner, offset, lcp, left = suffix.suffix_order(texts, 8)
    strings = [texts[o][s:] for o, s in zip(owner, offset)]
    assert strings == sorted(strings)
    for i in range(1, len(strings)):
        assert os.path.commonprefix(strings[i - 1 : i + 1]) == strings[i][: lcp[i]]
    want = set()
    for i in range(len(strings)):
        for j in range(i + 1, len(strings)):
            common = len(os.path.commonprefix([strings[i], strings[j]]))
            if common >= 8:
                lo = hi = i
                while lo > 0 and lcp[lo] >= common:
                    lo -= 1
                while hi + 1 < len(strings) and lcp[hi + 1] >= common:
                    hi += 1
                if len(set(left[lo : hi + 1].tolist())) > 1:
                    want.add((common, lo, hi))
    assert set(suffix.maximal_repeats(lcp, left, 8)) == want and want


def test_repeat_groups_list_all_places(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = [(1, "xx" + text), (2, text + "yy"), (3, "q" * 50 + text), (4, "none of it")]
    groups = suffix.maximal_repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"), 100)
    places = {r.repeat: set() for r in groups.collect()}
    for r in groups.collect():
        places[r.repeat].add((r.doc_id, r.start - {1: 2, 2: 0, 3: 50}[r.doc_id]))
    assert any({d for d, _ in p} == {1, 2, 3} and len({s for _, s in p}) == 1 for p in places.values())


@pytest.mark.parametrize("hot", [3, 5000])
def test_decontamination(spark, monkeypatch, hot):
    rng = random.Random(6)
    items = [(k, prose(rng, n)) for k, n in enumerate((3, 5, 9, 13, 14, 30, 12, 60))]
    docs = []
    for i in range(120):
        body = prose(rng, rng.randrange(0, 80)).split()
        if i % 3:
            part = rng.choice(items)[1].split()
            lo = rng.randrange(max(1, len(part) - 12))
            part = edited(rng, " ".join(part[lo : lo + rng.randrange(4, 40)]), rng.randrange(4)).upper().split()
            at = rng.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((i, "  ".join(body)))
    docs += [(500 + i, "same text here " + items[5][1]) for i in range(40)] + [(None, "É " + items[4][1]), (7, docs[7][1])]
    want = []
    for d, t in docs:
        for k, item in items:
            want += [(d, k, *span) for span in overlaps(t.lower().split(), item.split())]
    schemas = "doc_id long, text string, hash long, item string", "item_id long, text string, doc long"
    frames = [spark.createDataFrame([(*r, *[None] * (2 - i)) for r in rows], schemas[i]) for i, rows in enumerate((docs, items + items[:3]))]
    monkeypatch.setattr(decontam, "HOT", hot)
    rows = decontam.contaminated_spans(*frames).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str) and len(want) > 60
    texts = dict(docs)
    for r in rows:
        assert texts[r.doc_id][r.first_char : r.end_char].split() == texts[r.doc_id].split()[r.first_token : r.end_token]
    bad = {r.doc_id for r in rows}
    kept = decontam.clean_documents(*frames)
    assert kept.columns == frames[0].columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)
    assert decontam.contaminated_spans(frames[0], frames[1].limit(0)).collect() == decontam.contaminated_spans(frames[0].limit(0), frames[1]).collect() == []


def overlaps(doc, item):
    """Spans by comparing all aligned windows: items of 13 tokens or more by windows of 13 with two differences, shorter ones whole."""
    n, out = len(item), []
    width, most = (13, 2) if n >= 13 else (n, 2 * n // 13)
    if n < 5:
        return []
    for shift in range(width - n, len(doc) - width + 1):
        run = None
        for j in range(n - width + 1):
            if j + shift < 0 or j + shift + width > len(doc):
                continue
            if sum(doc[j + shift + x] != item[j + x] for x in range(width)) <= most:
                if run and j <= run[1]:
                    run[1] = j + width
                else:
                    run = [j, j + width]
                    out.append((shift, run))
    done = []
    for shift, (s, e) in out:
        equal = [x for x in range(s, e) if doc[x + shift] == item[x]]
        s, e = equal[0], equal[-1] + 1
        done.append((s + shift, e + shift, sum(doc[x + shift] != item[x] for x in range(s, e))))
    return done


def test_edit_distance_bits(spark):
    rng, pairs = random.Random(3), []
    for _ in range(800):
        a = [rng.choice("abé") for _ in range(rng.randrange(9))]
        b = [c if rng.random() < 0.8 else rng.choice(("", "z", c + "y")) for c in a]
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for e in (1, 2):
        assert df.where(~lines.within_edits(F.col("a"), F.col("b"), e).eqNullSafe(F.levenshtein("a", "b") <= e)).count() == 0


@pytest.mark.parametrize("edits", [1, 2])
def test_line_report(spark, edits):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(15, 40))) for _ in range(30)]
    docs = []
    for i in range(80):
        text = []
        for _ in range(rng.randrange(5)):
            x = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                p = rng.randrange(len(x))
                x[p : p + rng.randrange(2)] = rng.choice(("z", "q", ""))
            text.append("".join(x) + rng.choice(("", " ")))
        docs.append((i if i % 17 else None, "\n".join(text) if i % 13 else None))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    mark = {(r[0], r[1]): r[2] for r in df.select("doc_id", "text", F.xxhash64(whole_text())).collect()}
    places = sorted({
        ((d is None, d or 0, mark[d, t], n), line.strip(lines.SPACE)) for d, t in docs for n, line in enumerate((t or "").split("\n")) if line.strip(lines.SPACE)
    })
    first = {}
    for at, line in places:
        first.setdefault(line, at)
    near = {a for a in first for b in first if a != b and first[b] < first[a] and min(len(a), len(b)) >= 20 and distance(a, b) <= edits}
    gone = {}
    for at, line in places:
        if first[line] != at or line in near:
            gone.setdefault(at[:3], []).append(at[3])
    want = Counter((d, tuple(gone.get((d is None, d or 0, mark[d, t]), ()))) for d, t in docs)
    assert Counter((r.doc_id, tuple(r.removed)) for r in lines.line_report(df, edits).collect()) == want and near
    kept = lines.dedup_lines(df, edits)
    for r in kept.collect():
        assert r.text is None or all(line in {x for _, t in docs for x in (t or "").split("\n")} for line in r.text.split("\n"))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables not present")
def test_mix_equals_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = QUERIES["op8_mix"](spark, SMALL)
    want = db.sql(ORACLE["op8_mix"])
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert sorted(map(tuple, QUERIES["op8_mix"](spark, SMALL).select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_take_their_quotas(spark, shards):
    """Each shard takes as many blocks of a source as its quota says; all shards together take what one shard alone takes."""
    rng = random.Random(shards)
    docs = spark.createDataFrame([(i, prose(rng, rng.randrange(0, 90)), rng.choice(("a", "b", "b", "b", None))) for i in range(600)], "doc_id long, text string, source string")
    mixed = mixing.mix_documents(docs, shards=shards).collect()
    assert all(len(r.shard_taken) == shards and sum(r.shard_taken) == r.taken for r in mixed)
    plan = mixing.targets(mixing.sized(docs))
    quotas = {(r.source, r.shard): r.blocks * r.block for r in mixing.quotas(plan, shards).join(plan.select("idx", "source"), "idx").collect()}
    got = Counter()
    for r in mixed:
        for s, n in enumerate(r.shard_taken, 1):
            got[r.source, s] += n
    for key, want in quotas.items():
        full = sum(q for (source, _), q in quotas.items() if source == key[0])
        whole = sum(r.size for r in mixed if r.source == key[0])
        if full <= 2 * (whole - 256):  # a source that is held at twice its size gives its whole blocks alone
            assert got[key] == want, key
    alone = {r.doc_id: r.taken for r in mixing.mix_documents(docs, shards=1).collect()}
    assert {r.doc_id: r.taken for r in mixed} == alone
