"""Line dedup by a segment-partition edit join; DataFrame functions only.

A line is cut into `edits` + 1 segments; a line within `edits` edits of it holds one of them unchanged, near the same place.
Segments are filed under (length, number, text), longer or equal lines probe the substrings that the multi-match rule
allows. A pair must also have letter counts that `edits` edits can explain; it is verified by a bit-parallel automaton over
the 2 edits + 1 diagonals, one step per character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelattice.llm.common import stored, whole_text, written

EDITS, SHORTEST = 1, 20
LETTERS = "etanoi"
SPACE = " \t\x0b\x0c\r"


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are at most `edits` edits apart (Levenshtein).

    Bit k of r_e tells whether the first j characters of b and the first j + k - edits of a can be matched with e errors. Each
    character of b updates all diagonals of all r_e at once.
    """
    mask = (1 << (2 * edits + 1)) - 1
    both = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.length(a).alias("n"), F.length(b).alias("m"))
    start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << edits & mask).cast("int").alias(f"r{e}") for e in range(edits + 1)])

    def run(pair: Column) -> Column:
        def step(r: Column, j: Column) -> Column:
            here = F.get(pair["b"], j)
            same = F.lit(0)
            for k in range(2 * edits + 1):
                same = same.bitwiseOR(F.when(F.get(pair["a"], j + (k - edits)) == here, F.lit(1 << k)).otherwise(F.lit(0)))
            new: list[Column] = []
            for e in range(edits + 1):
                x = r[f"r{e}"].bitwiseAND(same)
                if e:
                    old = r[f"r{e - 1}"]
                    x = x.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[e - 1], 1).bitwiseAND(F.lit(mask)))
                new.append(x)
            return F.struct(*[x.cast("int").alias(f"r{e}") for e, x in enumerate(new)])

        last = F.aggregate(F.sequence(F.lit(0), pair["m"] - 1), start, step)[f"r{edits}"]
        last = F.when(pair["m"] == 0, start[f"r{edits}"]).otherwise(last)
        shift = pair["n"] - pair["m"] + edits
        bits = F.array(*[F.lit(1 << k) for k in range(2 * edits + 1)])
        return F.coalesce(last.bitwiseAND(F.get(bits, shift)) != 0, F.lit(False))

    return F.transform(F.array(both), run)[0]


def letter_counts(line: Column) -> Column:
    """Counts of some frequent letters, modulo 256, in the bytes of one long."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        n = F.size(F.split(line, c)).cast("long").bitwiseAND(F.lit(255))  # one more than there are; cheaper than replacing
        out = out.bitwiseOR(F.shiftleft(n, 8 * k))
    return out


def counts_differ(x: Column, y: Column) -> Column:
    """Sum of the differences of letter counts; an edit changes it by two at most. Counts are taken modulo 256."""
    out = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        d = F.abs(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(y, 8 * k).bitwiseAND(F.lit(255)))
        out = out + F.least(d, 256 - d)
    return out


def bounds(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i of `parts`; the longer ones come last."""
    small, long_ones = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    extra = F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - long_ones))
    return F.lit(i) * small + extra, small + F.when(F.lit(i) >= F.lit(parts) - long_ones, 1).otherwise(0)


def filed_keys(line: Column, edits: int) -> Column:
    n, keys = F.length(line), []
    for i in range(edits + 1):
        at, size = bounds(n, i, edits + 1)
        keys.append(F.xxhash64(n, F.lit(i), F.substring(line, at + 1, size)))
    return F.array(*keys)


def probe_keys(line: Column, edits: int) -> Column:
    """Hashes of the substrings at which a line of this length can hold a segment of a line up to `edits` shorter.

    With segments of a character at least (lines longer than 2 * edits) all of them lie inside the line.
    """
    keys = []
    for longer in range(edits + 1):
        n = F.length(line) - longer
        for i in range(edits + 1):
            at, size = bounds(n, i, edits + 1)
            for shift in range(max(-i, longer - (edits - i)), min(i, longer + (edits - i)) + 1):
                start = at + shift
                keys.append(F.xxhash64(n, F.lit(i), F.substring(line, start + 1, size)))
    return F.array(*keys)


def exploded(rows: DataFrame) -> DataFrame:
    """doc, th, no, line of the lines that hold more than white space (trimmed)."""
    lines = rows.select("doc", "th", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(SPACE))).where("line <> ''")


def near_pairs(lines: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """a, b (line hashes): pairs of different lines of `lines` (line), each of at least `shortest` characters, at most `edits`
    edits apart; pairs of equal length come in both orders.

    Keys and letter counts are results of the aggregation that makes lines distinct (which computes common parts once), and are
    written, so that they are computed once a line.
    """
    some = lines.where(F.length("line") >= max(shortest, 2 * edits + 1)).groupBy(F.xxhash64("line").alias("h"))
    line = F.first("line")
    own = written(some.agg(letter_counts(line).alias("bag"), filed_keys(line, edits).alias("filed"), probe_keys(line, edits).alias("probes")))
    filed = own.select(F.explode("filed").alias("key"), F.col("h").alias("a"), F.col("bag").alias("abag"))
    probes = own.select(F.explode("probes").alias("key"), F.col("h").alias("b"), F.col("bag").alias("bbag"))
    maybe = filed.join(probes, "key").where((F.col("a") != F.col("b")) & (counts_differ(F.col("abag"), F.col("bbag")) <= 2 * edits))
    maybe = maybe.select("a", "b").distinct()
    left = some.agg(line.alias("a_line")).withColumnRenamed("h", "a")
    right = some.agg(line.alias("b_line")).withColumnRenamed("h", "b")
    both = maybe.join(left, "a").join(right, "b")
    return both.where(within_edits(F.col("a_line"), F.col("b_line"), edits)).select("a", "b")


def repeated_lines(rows: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """doc, th, exact, near: numbers of the lines that go from every document that loses one; `rows` as in `keyed`."""
    lines = exploded(rows)
    at = F.struct(F.col("doc").isNull().alias("late"), "doc", "th", "no")
    places = written(lines.select(F.xxhash64("line").alias("h"), at.alias("at")))
    first = stored(places.groupBy("h").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    pairs = stored(near_pairs(lines.select("line"), edits, shortest))
    ends = pairs.join(first.select(F.col("h").alias("a"), F.col("first").alias("a_at")), "a").join(first.select(F.col("h").alias("b"), F.col("first").alias("b_at")), "b")
    later = ends.select(F.when(F.col("a_at") > F.col("b_at"), F.col("a")).otherwise(F.col("b")).alias("h")).distinct()
    first = first.join(later.withColumn("near", F.lit(True)), "h", "left").where("n > 1 or near")
    gone = places.join(stored(first), "h").where((F.col("at") != F.col("first")) | F.col("near"))
    return gone.groupBy(F.col("at.doc").alias("doc"), F.col("at.th").alias("th")).agg(
        F.array_sort(F.collect_set(F.when(F.col("at") != F.col("first"), F.col("at.no")))).alias("exact"),
        F.array_sort(F.collect_set(F.when(F.col("at") == F.col("first"), F.col("at.no")))).alias("near"),
    )


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__llm_doc", F.col("doc_id")).withColumn("__llm_th", F.xxhash64(whole_text()))


def line_report(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, removed (line numbers from 0, ascending) of every row of `docs` (doc_id, text).

    A line that holds more than white space goes if an equal line (trimmed) stands before it, in the order of doc_id (null
    last), text hash and line number; its first occurrence goes if a different line at most `edits` edits away, both of
    `shortest` characters or more, stands before it. Null texts have one empty line. Repeated rows count as one row and
    lose the same lines. Columns of other names are left aside; an empty table gives an empty result.
    """
    rows = keyed(docs).select("doc_id", F.col("__llm_doc").alias("doc"), F.col("__llm_th").alias("th"), whole_text().alias("text"))
    gone = repeated_lines(rows.select("doc", "th", "text"), edits, shortest).withColumnRenamed("doc", "d").withColumnRenamed("th", "t")
    every = rows.select("doc_id", "doc", "th", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    got = every.join(gone, every.doc.eqNullSafe(gone.d) & (every.th == gone.t), "left")
    n = {c: F.coalesce(F.size(c), F.lit(0)).cast("long") for c in ("exact", "near")}
    removed = F.coalesce(F.array_sort(F.concat("exact", "near")), F.array().cast("array<int>"))
    return got.select("doc_id", "n_lines", F.when(F.col("exact").isNull(), 0).otherwise(n["exact"]).cast("long").alias("n_exact"),
                      F.when(F.col("near").isNull(), 0).otherwise(n["near"]).cast("long").alias("n_near"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """The rows and columns of `docs` with the lines of `line_report` taken out of text; n_chars, if there, counts anew.

    A null text stays null; a text that loses all its lines becomes empty.
    """
    rows = keyed(docs)
    gone = repeated_lines(rows.select(F.col("__llm_doc").alias("doc"), F.col("__llm_th").alias("th"), whole_text().alias("text")), edits, shortest)
    gone = gone.select(F.col("doc").alias("__llm_d"), F.col("th").alias("__llm_t"), F.concat("exact", "near").alias("__llm_gone"))
    both = rows.join(gone, F.col("__llm_doc").eqNullSafe(F.col("__llm_d")) & (F.col("__llm_th") == F.col("__llm_t")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("__llm_gone"), i)), "\n")
    both = both.withColumn("text", F.when(F.col("__llm_gone").isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col("__llm_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return both.select(*docs.columns)
