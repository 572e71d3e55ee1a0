"""Personal data, n-gram scores, digests, pages and languages against plain versions, by accuracy or on small cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracelattice.llm import boosting, digest, extract, langid, ngrams, pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_version(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c.isdigit())
            twice = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and twice % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if ok[kind]:
                out.append((k, m.start(), m.end()))
    return out


def test_plain_spans():
    rng = random.Random(1)
    for _ in range(6000):
        text = "".join(rng.choice("ab@.@..-_1234 +5() 67890é") for _ in range(rng.randrange(60)))
        assert pii.plain_spans(text) == plain_version(text), text
    assert pii.plain_spans("1." + "0" * 5000 + ".2.3") == [(1, 0, 5006)]


def test_redactor_adds_spans_and_leaves_plain_text(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        number = f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        rows.append((i, f"please call +1 {number} about item {rng.randrange(10**9)} or lot {rng.randrange(10**8, 10**9)}." if i % 2 else "nothing to see in this text"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, thresholds = pii.fit_redactor(docs)
    assert model is not None
    got = {r.doc_id: r for r in pii.find_pii(docs, model, thresholds).collect()}
    for i, text in rows:
        r = got[i]
        assert set(filter(None, r.plain.split(","))) <= set(r.spans.split(","))
        assert r.plain == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in plain_version(text))
        if not i % 2:
            assert r.spans == "" and r.redacted == text


def test_redactor_finds_what_is_not_marked(spark):
    """Trained where phones have a plus and addresses their sign, it finds nine of ten without, and leaves plain numbers alone."""
    rng, rows = random.Random(4), []

    def phone():
        a, b, c = rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999)
        return rng.choice((f"1 ({a}) {b}-{c}", f"1-{a}-{b}-{c}", f"44 {a} {b} {c}", f"1.{a}.{b}.{c}"))

    def number():
        return rng.choice((f"item {rng.randrange(10**9, 10**10)}", f"lot {rng.randrange(10**8, 10**9)}", f"order {rng.randrange(10**13, 10**15)}"))

    def mail():
        return f"{rng.choice(('jo', 'ann', 'li.wu', 'max'))}{rng.randrange(99)}", f"{rng.choice(('mail', 'post-box', 'example'))}.{rng.choice(('com', 'org', 'de'))}"

    for i in range(900):
        rows.append((i, rng.choice((
            f"please call +{phone()} before noon about {number()}", f"the report on {number()} says nothing of {number()}",
            f"write to {'@'.join(mail())} or see {number()}", f"reach us on +{phone()} today", f"rivers and roads {rng.randrange(10**9)} and more",
        ))))
    model, thresholds = pii.fit_redactor(spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(thresholds[0], thresholds[3]) < 1
    planted, clean = [], []
    for i in range(300):
        p, (a, b) = phone(), mail()
        planted.append((f"please call {p} before noon", f"phone:12:{12 + len(p)}") if i % 2 else (f"write to {a} [at] {b} today", f"email:9:{9 + len(a) + 6 + len(b)}"))
        clean.append(f"the report on {number()} says nothing")
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted)] + [(1000 + i, t) for i, t in enumerate(clean)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_pii(docs, model, thresholds).collect()}
    for k in (0, 1):  # addresses, phones
        found = [got[i] == want for i, (_, want) in enumerate(planted) if i % 2 == k]
        assert sum(found) >= 0.9 * len(found), (k, sum(found), len(found))
    assert sum(got[1000 + i] != "" for i in range(len(clean))) <= 0.02 * len(clean)
    again = {r.doc_id: r.spans for r in pii.find_pii(docs.orderBy("doc_id"), *pii.fit_redactor(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert again == got  # equal probabilities are settled by place


def test_boosted_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit_trees(x[:2000], y[:2000])
    boosting.calibrate(model, x[2000:], y[2000:])
    p = model.probability(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95
    t = boosting.precise_threshold(p, y[2000:], 0.99)
    assert y[2000:][p >= t].mean() >= 0.99


def test_ngram_scores_equal_recursion(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.15)), 60)}" for _ in range(rng.randrange(0, 40)))) for i in range(150)] + [(None, None), (7, "w1 W2 unseen")]
    shares = (0.01, 0.03)
    tokens = [[*(t or "").lower().split(), "\n"] for _, t in rows]
    learn = [d is None or zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows]
    one = Counter(w for t, k in zip(tokens, learn) if k for w in t)
    total, kinds = sum(one.values()), len(one)
    known = {n: {w for w, c in one.items() if c >= max(2, s * total)} for n, s in zip((2, 3), shares)}
    many = Counter(tuple(t[i : i + n]) for t, k in zip(tokens, learn) if k for n in (2, 3) for i in range(len(t) - n + 1) if known[n].issuperset(t[i : i + n]))
    seen = defaultdict(float)
    for g, c in many.items():
        seen[g[:-1]] += c - 0.75

    def p(h, w):
        if not h:
            return (one[w] + 0.5) / (total + 0.5 * (kinds + 1))
        if h not in seen:
            return p(h[1:], w)
        c = one[h[0]] if len(h) == 1 else many[h]
        return max(many.get((*h, w), 0) - 0.75, 0) / c + (1 - seen[h] / c) * p(h[1:], w)

    assert abs(sum(p(("w0", "w1"), w) for w in one) + p(("w0", "w1"), "unseen") - 1) < 1e-9
    for block_bytes in (1 << 20, 700):
        got = ngrams.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), shares, block_bytes=block_bytes).collect()
        key = lambda r: (r[0] is None, r[0] or 0, round(r[4], 6))
        want = sorted(((d, k, len(t), sum(one[w] > 0 for w in t), sum(math.log10(p((), w)) for w in t), sum(math.log10(p(tuple(t[max(0, i - 2) : i]), w)) for i, w in enumerate(t))) for (d, _), k, t in zip(rows, learn, tokens)), key=key)
        have = sorted(((r.doc_id, r.learn, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
        assert [w[:4] for w in want] == [h[:4] for h in have] and {r.train_tokens for r in got} == {total}
        assert np.allclose([w[4:] for w in want], [h[4:] for h in have])


def test_every_word_has_contexts(spark):
    """No vocabulary bounds the higher orders: words seen once have bigrams and trigrams too."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[::9])]
    tokens = [[*t.split(), "\n"] for _, t in rows]
    learn = [zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows]
    many = Counter(tuple(t[i : i + n]) for t, k in zip(tokens, learn) if k for n in (1, 2, 3) for i in range(len(t) - n + 1))
    one = {g: c for g, c in many.items() if len(g) == 1}
    total, kinds, seen = sum(one.values()), len(one), defaultdict(float)
    for g, c in many.items():
        seen[g[:-1]] += c - 0.75

    def p(h, w):
        if not h:
            return (one.get((w,), 0) + 0.5) / (total + 0.5 * (kinds + 1))
        if h not in seen:
            return p(h[1:], w)
        return max(many.get((*h, w), 0) - 0.75, 0) / many[h] + (1 - seen[h] / many[h]) * p(h[1:], w)

    want = {d: sum(math.log10(p(tuple(t[max(0, i - 2) : i]), w)) for i, w in enumerate(t)) for (d, _), t in zip(rows, tokens)}
    for block_bytes in (1 << 20, 900):
        got = {r.doc_id: r.score for r in ngrams.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=block_bytes).collect()}
        assert got.keys() == want.keys() and np.allclose([got[d] for d in want], list(want.values()))


def test_digests(spark):
    rng = random.Random(9)
    text = " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "epsilon", "zeta")) + str(rng.randrange(99)) for _ in range(600))
    near, far = text.replace("7", "8", 5), "".join(rng.choice("qwertz uiop") for _ in range(len(text)))
    a, b, c = (digest.digest(t.encode()) for t in (text, near, far))
    assert digest.likeness(a, a) == 1 and digest.likeness(a, b) > 0.9 > digest.likeness(a, c) and digest.difference(a, c) == digest.difference(c, a) <= digest.LIMIT
    rows = [(i if i else None, (None if i == 3 else text[: i * 37 % 900])) for i in range(60)]
    for per in (1, 7, 1000):
        got = {r.doc_id: r for r in digest.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), per).collect()}
        assert len(got) == len(rows)
        for k, (d, t) in enumerate(rows):
            t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
            whole = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            r = got[d]
            assert (r.edited, r.n_chars, r.fingerprint, r.edited_fingerprint) == (whole, len(t), digest.digest(t.encode()), digest.digest(whole.encode()))
            assert r.near_next == digest.likeness(r.fingerprint, digest.digest(after.encode())) and 0 <= r.near_edited <= 1
    assert digest.sha256_hex("é") == hashlib.sha256("é".encode()).hexdigest()


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style></head><body><header>Site <h2>name</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div>{open}<h1>Big&nbsp;title</h1><p>First  <b>bold</b>
 words &lt;here&gt; of the story go on and on.</p><aside>by the way</aside><script>var a = "</p>";</script><p>Second<br>line of it, long enough to count.</p>
<ul><li>one item of a list</li><li>two items</li></ul><div class="adBox">buy</div><form><input name=q><label>Search</label></form>{close}<section id="comments"><p>I like it very much indeed</p></section>
<div class='sidebar'><p>More stories for you to read now</p></div><footer>&copy; 2020</footer></body></html>"""
TEXT = "Big title\n\nFirst bold words <here> of the story go on and on.\n\nSecond line of it, long enough to count.\n\none item of a list\n\ntwo items"


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div>", "</div>")])
def test_page_text(spark, around):
    train = PAGE.format(open="<article>", close="</article>")
    pages = spark.createDataFrame([(i, "u", train) for i in range(40)], "page_id long, url string, html string")
    weights = extract.fit_weights(pages)
    assert weights["word"] > 0 and all(v < 0 for k, v in weights.items() if k not in ("word", "link"))
    assert extract.main_text(PAGE.format(open=around[0], close=around[1]), weights) == TEXT


@pytest.mark.parametrize("name", ["overflow-hidden", "no-sidebar", "has-comments", "with-ads", "widget-text", "search-result", "form"])
def test_names_that_hold_a_noise_word_keep_the_text(name):
    story = "<p>" + "</p><p>".join("one of many paragraphs of the story " * 3 for _ in range(6)) + "</p>"
    open_, close = ("<form action='x'>", "</form>") if name == "form" else (f'<div class="{name}">', "</div>")
    whole = extract.main_text(f"<html><body><div>{story}</div></body></html>", extract.DEFAULT)
    assert whole.count("story") == 18
    for page in (f"<html><body>{open_}{story}{close}</body></html>", f"<html><body><article>{open_}{story}{close}</article></body></html>"):
        assert extract.main_text(page, extract.DEFAULT) == whole


def test_hidden_elements_go():
    story = "<p>" + "some words of the story " * 9 + "</p>"
    for attrs in ("hidden", 'hidden=""', "class='hidden'", 'style="color:red; display:none"', "aria-hidden=true", 'class="sidebar"'):
        assert "secret" not in extract.main_text(f"<body>{story}<div {attrs}>secret thing</div>{story}</body>", extract.DEFAULT)
    for attrs in ('hidden="until-found"', 'class="overflow-hidden"', "data-hidden=true", 'title="not hidden"'):
        assert "secret" in extract.main_text(f"<body>{story}<div {attrs}>secret thing</div>{story}</body>", extract.DEFAULT)


def test_best_run():
    rng = random.Random(0)
    for _ in range(200):
        x = [rng.randrange(-4, 5) for _ in range(12)]
        lo, hi = extract.best_run(x)
        assert sum(x[lo:hi]) == max([0, *(sum(x[i:j]) for i in range(12) for j in range(i + 1, 13))])


def test_gradients():
    net, rng = langid.Network(["a", "b", "c"], 3, 1), np.random.default_rng(0)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, y = rng.integers(97, 101, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, grad = net.gradients(x, y)
    for k, v in net.p.items():
        at = (98, 2) if k.startswith("table") else tuple(rng.integers(s) for s in v.shape)
        old, losses = v[at], []
        for step in (1e-2, -1e-2):
            v[at] = old + step
            losses.append(net.gradients(x, y)[0])
        v[at] = old
        assert abs((losses[0] - losses[1]) / 2e-2 - grad[k][at]) < 1e-4


def test_languages_of_held_out_documents(spark):
    rng = random.Random(3)
    parts = {"en": "the ing er on at th and".split(), "fr": "é eau oi ç que è le".split(), "de": "sch ü ung ß keit ä der".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 60))), k) for i in range(240) for k in (rng.choice(list(parts)),)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit_language_model(docs, steps=80)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs.drop("lang"), net).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i] == k for i, k in held) >= 0.95 * len(held) > 0
    assert langid.predict(net, [b"", b"123 +-", "ß".encode()])[:2] == [("und", 0.0), ("und", 0.0)]
    assert docs.where(langid.accepted(net)).count() >= 0.95 * len(rows)
