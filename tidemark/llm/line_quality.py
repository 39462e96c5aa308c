"""Document quality rules: word and repetition statistics, and cross-document line frequency.

Only DataFrame functions are used. Each text is read once, for its statistics and the hashes of its normalised lines;
repeated three-word windows are found inside the row. The distinct documents with a line are counted for each host,
lines above the limits are removed, and documents of which too little is left are rejected. A frequent line is added
up before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, small, text_of

#: A line is boilerplate if more than MIN_DOCS and SHARE of its host's documents have it, or more than MANY_DOCS whatever
#: the host's size. A document is depleted if fewer than KEEP_SHARE of its words are left without such lines.
MIN_DOCS, SHARE, MANY_DOCS, KEEP_SHARE = 20, 0.01, 100, 0.2


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _repeated(words: str) -> Column:
    """How many words stand in three-word windows that occur at least twice.

    Window hashes are sorted as long integers whose low bits hold the position; neighbours are compared by their
    full hashes, and the lengths that their positions cover are summed. Each array is bound to a lambda's name,
    so that it is made once wherever the optimizer moves the expression.
    """
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    bits = "cast(greatest(1, ceil(log2(size(hs) + 2))) as int)"
    at = lambda k: f"cast({k} & (shiftleft(1L, b) - 1) as int)"
    full = lambda k: f"hs[{at(k)}]"
    twins = f"filter(s, (k, j) -> (j > 0 and {full('k')} = {full('s[greatest(j - 1, 0)]')}) or (j < size(s) - 1 and {full('k')} = {full('s[least(j + 1, size(s) - 1)]')}))"
    covered = let("p", f"sort_array(transform({twins}, k -> {at('k')}))", "aggregate(transform(p, (x, i) -> cast(if(i = 0, 3, least(3, x - p[greatest(i - 1, 0)])) as bigint)), 0L, (y, x) -> y + x)")
    packed = "sort_array(transform(hs, (h, i) -> shiftleft(shiftright(h, b), b) | i))"
    counted = f"if(size(array_distinct(hs)) = size(hs), 0L, {let('b', bits, let('s', packed, covered))})"
    hashes = "if(size(ws) < 3, cast(array() as array<bigint>), transform(slice(ws, 1, greatest(size(ws) - 2, 0)), (w, i) -> xxhash64(w, ws[i + 1], ws[i + 2])))"
    return F.expr(let("ws", words, let("hs", hashes, counted)))


def plain(line: Column) -> Column:
    """A line as it is counted: lower case, digits as 0, single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " ")))


def statistics(docs: DataFrame) -> DataFrame:
    """A row number, doc_id, source, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the lines
    (hash and words of each that has any) of each row: all that is needed of the texts, in one pass over them."""
    t = docs.select("doc_id", docs["source"].cast("string").alias("source"), text_of(docs).alias("text"))
    t = t.withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    lines = _lines(F.col("text"))
    counted = F.transform(F.filter(F.transform(F.split("text", "\n"), plain), lambda x: F.length(x) > 0), lambda x: F.struct(F.xxhash64(x).alias("hash"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("words")))
    return t.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "source",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated("words").alias("n_repeat_words"),
        counted.alias("lines"),
    )


def boilerplate(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """source and line hash of the lines that too many documents of their host have; rows: doc_id, source, text_hash, lines.

    Documents are told apart by doc_id, those without one by their text.
    """
    doc = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_hash").cast("string")))
    hosts = rows.select("source", doc.alias("doc")).distinct().groupBy("source").agg(F.count("*").alias("docs"))
    own = rows.select("source", doc.alias("doc"), F.explode(F.array_distinct("lines.hash")).alias("hash")).distinct()
    often = own.groupBy("source", "hash").agg(F.count("*").alias("docs_with")).where(F.col("docs_with") > min_docs)
    a, h = often.alias("a"), hosts.alias("h")
    over = a.join(h, F.col("a.source").eqNullSafe(F.col("h.source"))).where(F.col("docs_with") > F.least(F.col("docs") * share, F.lit(many_docs)))
    return over.select("a.source", "hash")


def rate(docs: DataFrame, keep_share: float = KEEP_SHARE, **limits) -> DataFrame:
    """Quality statistics and the verdict for each row of ``docs``.

    Returns doc_id, source, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost (words in
    lines that are boilerplate on the document's host, its ``source``), base_failed (under 50 words, or more than
    half of them in repeated three-word windows), kept (not base_failed, and not depleted by the loss of those lines)
    and bad_lines (hashes of the lines that go, see ``without_lines``).

    A null text counts as empty and fails; null sources form one host; repeated rows and several texts of one doc_id
    are one document of the host, rows without a doc_id one for each text; equal rows get equal verdicts; an empty
    table gives no rows. Other columns don't matter.
    """
    s = cut(statistics(docs))
    often = cut(boilerplate(s, **limits))
    line, o = s.select("row", "source", F.inline("lines")).alias("l"), small(often).alias("o")
    hit = line.join(o, F.col("l.source").eqNullSafe(F.col("o.source")) & (F.col("l.hash") == F.col("o.hash")))
    lost = hit.groupBy("row").agg(F.sum("l.words").alias("lost"), F.sort_array(F.collect_set("l.hash")).alias("bad"))
    joined = s.join(lost, "row", "left")
    gone = F.coalesce("lost", F.lit(0).cast("long"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    kept = ~failed & (F.col("n_words") - gone >= F.col("n_words") * keep_share)
    bad = F.coalesce("bad", F.array().cast("array<long>"))
    return joined.select("doc_id", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", gone.alias("n_lost"), failed.alias("base_failed"), kept.alias("kept"), bad.alias("bad_lines"))


def without_lines(text: Column, bad: Column) -> Column:
    """``text`` without its lines whose hashes are in ``bad``."""
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(bad, F.xxhash64(plain(x))))
    return F.when(F.size(bad) > 0, F.array_join(left, "\n")).otherwise(text)
