"""Byte-pair encoding of whole texts by last tokens: shared prefixes of words are encoded once, then decoded again.

The encoding of a word is fixed by the last token of each of its prefixes: before the last token of a prefix stands the encoding
of what is left of it. So the state of a prefix is one token, and a walk over the trie of all distinct words of a batch, depth
first, finds it once for all words that begin alike. A token may follow another if merging both together would leave the seam
between them open; that depends on the two tokens alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracelattice.llm.common import arrow_schema, pieces, whole_text

#: Fixed value: how byte-level vocabularies of this kind cut text into words.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Scripts where libraries differ by their Unicode version; the vocabulary's own library cuts texts that hold them.
NEW_SCRIPTS = re.compile("[\U00010000-\U0001EFFF\U0001FB00-\U0010FFFF]")
#: The same for ASCII texts.
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
MOST_WORDS = 600_000  # words whose encodings a task keeps between batches; then it starts anew
MOST_PAIRS = 1_000_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE vocabulary (the JSON file of the tokenizers library).

    Every token but single bytes and special ones must come from exactly one merge of two older tokens, and special tokens must
    match plainly (no stripping, no word limits, no normalizer); otherwise ValueError.
    """

    def __init__(self, data: bytes):
        spec = json.loads(data)
        letters = byte_letters()
        self.data, self.library = data, None
        vocab, pre = spec["model"]["vocab"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a plain byte-level vocabulary")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("a special token with rules of its own")
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        self.number: dict[bytes, int] = {}
        for text, i in vocab.items():
            if text not in self.special:
                self.bytes_of[i] = bytes(letters[c] for c in text)
                self.number[self.bytes_of[i]] = i
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.pair_rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        made = {i: -1 for b, i in self.number.items() if len(b) == 1}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            if whole in made or a not in made or b not in made:
                raise ValueError("a token without exactly one merge of older tokens")
            made[whole], parts[whole], self.pair_rank[a, b] = rank, (a, b), rank
        if len(made) != len(self.number):
            raise ValueError("tokens that no merge makes")
        self.made, self.parts = made, parts
        self.whole = {i for i in made if i not in parts}  # tokens whose own bytes are encoded as themselves
        for i in sorted(parts, key=made.get):
            a, b = parts[i]
            if a in self.whole and b in self.whole and not self.crossed(a, b, made[i]):
                self.whole.add(i)
        self.suffix_machine()
        self.seams: dict[int, bool] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def crossed(self, a: int, b: int, before: int = NEVER) -> bool:
        """Does a merge of rank below `before` join the edges of two adjacent tokens while they are being built?

        Lower ranks come first, equal ones from left to right: a piece at the seam is merged across it if that happens before
        either piece is taken in by its own token; of equal ranks the left one has gone already, the right one not yet.
        """
        rank, made, parts = self.pair_rank.get, self.made, self.parts
        x, x_gone = a, before
        while True:  # down the right edge of a, and for each piece down the left edge of b
            y, y_gone = b, before
            while True:
                r = rank((x, y))
                if r is not None and r < x_gone and r <= y_gone and r < before:
                    return True
                if y not in parts:
                    break
                y, y_gone = parts[y][0], made[y]
            if x not in parts:
                return False
            x, x_gone = parts[x][1], made[x]

    def suffix_machine(self) -> None:
        """States are the beginnings of tokens (0: none); arcs[state][byte] leads on, shorter[state] to the longest proper suffix that
        is a state, ends[state] lists the tokens that end there, longest first, as (length, token)."""
        self.arcs: list[dict[int, int]] = [{}]
        token_at: dict[int, int] = {}
        for token, i in self.number.items():
            at = 0
            for c in token:
                nxt = self.arcs[at].get(c)
                if nxt is None:
                    nxt = self.arcs[at][c] = len(self.arcs)
                    self.arcs.append({})
                at = nxt
            if i in self.whole:
                token_at[at] = i
        self.shorter, self.ends = [0] * len(self.arcs), [()] * len(self.arcs)
        queue = [0]
        for at in queue:
            for c, nxt in self.arcs[at].items():
                queue.append(nxt)
                if at:
                    self.shorter[nxt] = self.step(self.shorter[at], c)
                i = token_at.get(nxt)
                own = () if i is None else ((len(self.bytes_of[i]), i),)
                self.ends[nxt] = own + self.ends[self.shorter[nxt]]

    def step(self, at: int, c: int) -> int:
        """The state after one more byte."""
        while True:
            nxt = self.arcs[at].get(c)
            if nxt is not None:
                return nxt
            if not at:
                return 0
            at = self.shorter[at]

    def closed(self, seam: int) -> bool:
        """Is the pair of tokens a * size + b joined across its seam? Remembered for MOST_PAIRS pairs."""
        if len(self.seams) >= MOST_PAIRS:
            self.seams.clear()
        joined = self.seams[seam] = self.crossed(*divmod(seam, len(self.bytes_of)))
        return joined

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Every distinct word with its tokens. Sorted words are the trie in depth-first order; `path` holds the last tokens from
        the root down to the word at hand, `states` those of the suffix machine, of which the part shared with the next word stays."""
        arcs, ends, seams, size, bytes_of = self.arcs, self.ends, self.seams, len(self.bytes_of), self.bytes_of
        path, states, before = [0], [0], b""
        for word in sorted(words):
            n, d = min(len(before), len(word)), 0
            if before[:n] == word[:n]:
                d = n
            else:
                while before[d] == word[d]:
                    d += 1
            del path[d + 1:], states[d + 1:]
            at = states[d]
            for c in word[d:]:
                d += 1
                nxt = arcs[at].get(c)
                if nxt is None:  # looked up once: at most states times bytes arcs
                    nxt = arcs[at][c] = self.step(at, c)
                at = nxt
                states.append(at)
                for k, t in ends[at]:
                    if k == d:
                        break
                    seam = path[d - k] * size + t
                    joined = seams.get(seam)
                    if not (self.closed(seam) if joined is None else joined):
                        break
                else:
                    raise ValueError("bytes that the vocabulary does not cover")
                path.append(t)
            ids = []
            while d:
                ids.append(path[d])
                d -= len(bytes_of[path[d]])
            yield word, ids[::-1]
            before = word

    def words(self, text: str) -> list[str]:
        """The words between which no merge happens, in order."""
        if text.isascii():
            return ASCII_PATTERN.findall(text)
        if not NEW_SCRIPTS.search(text):
            return PATTERN.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.data.decode()).pre_tokenizer
        return [text[s:e] for _, (s, e) in self.library.pre_tokenize_str(text)]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of token numbers; bytes that are no UTF-8 become U+FFFD."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(data: bytes) -> Vocabulary:
    """The tables of a vocabulary file, built once in each Python worker."""
    return Vocabulary(data)


class TextEncoder:
    """Encodes texts, keeping the tokens of words seen before (at most MOST_WORDS of them)."""

    def __init__(self, vocab: Vocabulary, special: bool):
        self.vocab, self.special = vocab, special and vocab.cut is not None
        self.known: dict[str, bytes] = {}

    def parts(self, text: str) -> list[str | int]:
        """Words of the text, and the number of each special token that stands in it."""
        if not self.special or not self.vocab.cut.search(text):
            return self.vocab.words(text)
        out: list[str | int] = []
        for i, part in enumerate(self.vocab.cut.split(text)):
            out += [self.vocab.special[part]] if i % 2 else self.vocab.words(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token numbers of every text as little-endian 32-bit integers."""
        cut = [self.parts(t) for t in texts]
        every = set().union(*cut)
        new = every.difference(self.known)
        if len(self.known) + len(new) > MOST_WORDS:
            self.known, new = {}, every
        known = self.known
        special = {w for w in new if isinstance(w, int)}
        known.update({i: i.to_bytes(4, "little") for i in special})
        for word, ids in self.vocab.encode_words([w.encode() for w in new - special]):
            known[word.decode()] = pack(f"<{len(ids)}I", *ids)
        return [b"".join([known[w] for w in words]) for words in cut]


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver: fixed in size, it goes to the workers as a whole."""
    with open(path, "rb") as f:
        return f.read()


DDL = "doc_id long, n_tokens long, ids binary, decoded string"


def encode_documents(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers), decoded (the text of these ids) of every row of `docs` (doc_id, text).

    `path` is the JSON file of a byte-level BPE vocabulary on the driver. With `special`, special tokens written out in a text
    become their token, as in the tokenizers library; else they are plain text. No token is added, none is cut off or padded.
    Null texts are empty and have no tokens; a very long text is one row of work, word by word. Repeated rows and null ids give
    a row each; other columns are left aside; an empty table gives an empty result.
    """
    data, out = docs.sparkSession.sparkContext.broadcast(file_bytes(path)), arrow_schema(DDL)

    def run(batches):
        vocab = vocabulary(data.value)
        encoder = TextEncoder(vocab, special)
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").cast(pa.int64())
            for start, end in pieces(texts):
                encoded = encoder.encode(texts[start:end])
                yield pa.RecordBatch.from_arrays([
                    ids[start:end], pa.array([len(e) // 4 for e in encoded], pa.int64()), pa.array(encoded, pa.binary()),
                    pa.array([vocab.decode(np.frombuffer(e, "<u4").tolist()) for e in encoded], pa.string()),
                ], schema=out)

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, DDL)
