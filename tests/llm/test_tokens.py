"""BPE by last tokens, alignment of tokenizations and spelling variants against libraries and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracelattice.llm import alignment, bpe, variants
from tracelattice.llm.queries import QUERIES

JSON, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SMALL = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "a", "\n\n \t", "<|endoftext|>", "x<|endoftext|> y <|endoftext|><|endoftext|>", "<s> </s> <unk> <0x41>", "▁ mark",
    "  two  spaces  ", "don't we'll I'VE", "naïve café ÀÿÞ", "漢字かな交じり", "🙂🙃 \U00011de0 \U0001f468‍\U0001f469", "\x00\x1c\x1d\x85　", "a" * 5000,
    "=-" * 3000, " " * 999, "0123456789" * 400, "é" * 700,
]


def noise(rng, n):
    parts = ["ab", "a ", "abc'st ", "0123 a", "\n \t", "é漢字ﬁ🙂", "-=_", "the ing er on at th ", "\x85　 a"]
    return ["".join(rng.choice(rng.choice(parts)) for _ in range(rng.randrange(1, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    prose = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    return ODD + noise(random.Random(2), 300) + prose


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None, 0) for i, t in enumerate(texts)] + [(None, "a null id", "x", 1), (3, "a", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, block int").repartition(3)


@pytest.mark.parametrize("special", [True, False])
def test_bpe_equals_the_library_and_comes_back(docs, texts, special):
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = not special
    rows = bpe.encode_documents(docs, JSON, special).collect()
    assert len(rows) == len(texts) + 2
    by_id = {r.doc_id: r for r in rows if r.decoded != "a"}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        if text == "a":
            continue
        got = by_id[i]
        assert np.frombuffer(bytes(got.ids), "<u4").tolist() == want and got.n_tokens == len(want), text
        assert got.decoded == library.decode(want, skip_special_tokens=False) == (text or "")


def test_bpe_of_many_equal_letters():
    vocab, library = bpe.Vocabulary(bpe.file_bytes(JSON)), Tokenizer.from_file(JSON)
    words = [s * n for s in ("a", "-", "=", "*", "ab", "aab", "é", " ", "\n", "0") for n in range(1, 140)]
    letter = {b: c for c, b in bpe.byte_letters().items()}
    for word, ids in vocab.encode_words({w.encode() for w in words}):
        assert ids == [t.id for t in library.model.tokenize("".join(letter[b] for b in word))]


def test_other_vocabularies_are_refused(tmp_path):
    data = bpe.file_bytes(JSON).decode()
    for a, b in (('"add_prefix_space":false', '"add_prefix_space":true'), ('"single_word":false', '"single_word":true')):
        changed = re.sub(a.replace(":", r":\s*"), b, data, count=1)
        assert changed != data
        with pytest.raises(ValueError):
            bpe.Vocabulary(changed.encode())


def test_gallop():
    rng = np.random.default_rng(1)
    for n_short, n_long in ((1, 1), (5, 400), (300, 301), (1000, 90_000), (90_000, 90_000)):
        long = np.sort(rng.choice(200_000, n_long, replace=False))
        short = np.unique(rng.choice(np.append(np.arange(0, long[-1], 2), long), n_short))
        assert (alignment.gallop(short, long, np.array([0]), np.array([0])) == np.searchsorted(long, short)).all()


def aligned_by_bytes(texts):
    """The contract by plain byte sets."""
    library, processor = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    library.encode_special_tokens = True
    letters, out, seen, links_of = bpe.byte_letters(), [], Counter(), []
    for text in texts:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = processor.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in library.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(processor.id_to_piece(i)[3:5], 16)]) if processor.is_byte(i) else processor.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + text).encode() if text else b""
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            a = b = bytes_a = bytes_b = []
        owner_a = [i for i, x in enumerate(bytes_a) for _ in x]
        owner_b = [i for i, x in enumerate(bytes_b) for _ in x]
        links = sorted(set(zip(owner_a, owner_b)))
        ends = sorted(set(np.cumsum([len(x) for x in bytes_a]).tolist()) & set(np.cumsum([len(x) for x in bytes_b]).tolist()))
        groups, start = [], 0
        for end in map(int, ends):
            groups.append(",".join(str(a[i]) for i in dict.fromkeys(owner_a[start:end])) + "|" + ",".join(str(b[i]) for i in dict.fromkeys(owner_b[start:end])))
            start = end
        pairs = [(a[i], b[j]) for i, j in links]
        seen.update(set(pairs))
        links_of.append(pairs)
        out.append((len(a), len(b), len(groups), len(links), ";".join(groups)))
    most = defaultdict(int)
    for (a, _), n in seen.items():
        most[a] = max(most[a], n)
    return [(na, nb, ng, nl, sum(seen[p] == most[p[0]] for p in pairs), sum(seen[p] for p in pairs), g) for (na, nb, ng, nl, g), pairs in zip(out, links_of)], seen


@pytest.mark.parametrize("block", [1, 2 << 20])
def test_alignment_against_byte_sets(docs, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    rows = docs.select("doc_id", "text").collect()
    want, seen = aligned_by_bytes([r.text for r in rows])
    got = alignment.align_documents(docs, JSON, MODEL).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((r.doc_id, *w) for r, w in zip(rows, want)), key=key)
    digests = alignment.align_documents(docs, JSON, MODEL, digests=True).where("doc_id is not null").select("doc_id", "groups").collect()
    by_id = {i: w[-1] for (i, _), w in zip(rows, want)}
    assert all(r.groups == (hashlib.sha256(by_id[r.doc_id].encode()).hexdigest() if by_id[r.doc_id] else "") for r in digests if r.doc_id != 3)
    links = alignment.linked_tokens(docs, JSON, MODEL).collect()
    assert {(r.a, r.b): r.n for r in links} == dict(seen)


def edits(word, letters):
    """All strings one edit away over some letters."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
    return out - {word}


def variants_by_sets(rows, least=7, slip=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    form = {}
    letters = sorted({c for w in counts for c in w})
    near = {w: [v for v in edits(w, letters) if v in counts] for w in counts}
    for w, ns in near.items():
        if ns:
            best = min(ns, key=lambda v: (-counts[v], v))
            if counts[best] >= 10 * counts[w]:
                form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), counts[form[w]] if w in form else None, root))
    return sorted(out)


@pytest.fixture(scope="module")
def misspelt(spark):
    rng, rows = random.Random(8), []
    bases = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(6, 12))) for _ in range(40)] + ["aaaaaaa", "abababab", "ÀÉ÷ÿÀÉ÷ÿ", "LongestWord" * 30]
    for i in range(1500):
        words = []
        for _ in range(rng.randrange(0, 25)):
            w = bases[int(rng.random() ** 3 * len(bases))]
            for _ in range(rng.choice((0, 0, 0, 0, 0, 1, 1, 2))):
                p = rng.randrange(len(w))
                w = rng.choice((w[:p] + w[p + 1:], w[:p] + rng.choice("abcdé") + w[p:], w[:p] + rng.choice("abcdé") + w[p + 1:]))
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice((" ", ", ", "1", "_")).join(words)))
    rows += [(None, "wordone wordone"), (None, None), (5, ""), (5, "wordtwo wordtwo wordtwo"), *[(9000 + i, "wordthree " * 4) for i in range(8)], (9900, "wordthre wordthre")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(4), rows


@pytest.mark.parametrize("group", [2, 60, variants.GROUP])
def test_variants_against_edit_sets(misspelt, group):
    docs, rows = misspelt
    got = variants.spelling_variants(docs, group=group).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = variants_by_sets(rows)
    assert sorted(map(tuple, got)) == want
    assert any(w[3] for w in want) and any(w[3] and w[5] != w[3] for w in want)


def test_variants_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_variants"](spark, SMALL).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == variants_by_sets(rows)


def test_large_groups_are_split(spark):
    words = spark.createDataFrame([(f"samestart{a}{b}{c}", 2) for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"], "word string, n long")
    got = variants.near_words(words, group=50).collect()
    assert len(got) == 1000 and all(r.near == 27 for r in got)


def test_forms_are_followed(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}", 1) for i in range(11)], "word string, form string, form_n long")
    assert {(r.word, r.root) for r in variants.roots_of(forms).collect()} == {(f"w{i}", "w11") for i in range(11)}


def test_queries_of_the_table(spark):
    library = Tokenizer.from_file(JSON)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op13_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    want, _ = aligned_by_bytes(list(texts.values()))
    got = QUERIES["op11_align_tokens"](spark, SMALL).collect()
    by_id = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in got}
    assert by_id == {i: w[:6] for i, w in zip(texts, want)}
