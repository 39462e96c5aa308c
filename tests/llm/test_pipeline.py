"""The pipeline against brute force: stage by stage on its own input, and as a whole."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from tests.llm.test_corpus import brute_components, brute_lines, simhash_of, words_of

SF = "/root/testdata/sf0.001"


def quality(rows):
    """(doc_id, text, source) of the documents that stay, with the lines that stay."""
    out = []
    for (i, t, source), (lost, left) in zip(rows, brute_lines(rows)):
        w = words_of(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        if len(w) >= 50 and 2 * len(covered) <= len(w) and len(w) - lost >= 0.2 * len(w):
            out.append((i, left, source))
    return out


def near_dedup(rows):
    root = brute_components([simhash_of(t) for _, t, _ in rows])
    first = {}
    for i, t, _ in rows:
        first[root[simhash_of(t)]] = min(first.get(root[simhash_of(t)], i), i)
    return [r for r in rows if r[0] in set(first.values())]


def leaks(text, items):
    """Whether an item is within a fifth of its words, in edits, of some part of the text."""
    plain = lambda t: [x for w in t.split() if (x := "".join(filter(str.isalnum, w)).lower())]
    ids = defaultdict(lambda: len(ids))
    text = np.array([ids[w] for w in plain(text)])
    for item in items:
        item = [ids[w] for w in plain(item)]
        row, at = np.zeros(len(text) + 1, int), np.arange(len(text) + 1)
        for i, x in enumerate(item):
            up = np.empty_like(row)
            up[0] = i + 1
            up[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != x))
            row = np.minimum.accumulate(up - at) + at
        if item and row.min() <= len(item) // 5:
            return True
    return False


def mixture(rows):
    """doc_id and copies, by sorting every source's documents by their hashes."""
    size = {i: len(words_of(t)) for i, t, _ in rows}
    by = defaultdict(list)
    for i, _, source in rows:
        by[source].append(i)
    sources = sorted(by, key=lambda x: (x is None, x or ""))
    weight = {x: k % 3 + 1 for k, x in enumerate(sources)}
    total = {x: sum(size[i] for i in by[x]) for x in sources}
    target, free, rest = {}, list(sources), float(sum(total.values()))
    while free:
        share = {x: rest * weight[x] / sum(weight[y] for y in free) for x in free}
        over = [x for x in free if share[x] >= 3 * total[x]]
        if not over:
            target |= share
            break
        for x in over:
            target[x] = 3.0 * total[x]
            rest -= target[x]
            free.remove(x)
    hashed = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    copies = {}
    for x in sources:
        passes = min(math.floor(target[x] / total[x]), 3) if total[x] else 0
        left, chosen, edge = math.floor(target[x] - passes * total[x]), set(), None
        for i in sorted(by[x], key=hashed):
            if edge is None and size[i] <= left:
                left -= size[i]
                chosen.add(i)
            elif edge is None:
                edge, gap, done = i, left, False
            elif not done and size[i] <= gap:
                if size[i] <= left:
                    left -= size[i]
                    chosen.add(i)
                else:
                    done = True
                    if size[i] - left < left:
                        chosen.add(i)
        for i in by[x]:
            copies[i] = min(passes + (i in chosen), 3)
    return copies


def test_run_by_brute_force(spark):
    import corpus_pipeline as cp
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = near_dedup(quality(rows))
    rows = [r for r in rows if not leaks(r[1], items)]
    copies, t, start, want = mixture(rows), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, text, _ in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        for _ in range(copies[i]):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in cp.run(spark, SF).collect()) == want


def test_stages(spark):
    import corpus_pipeline as cp
    from tidemark.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    seen, at = [], docs
    for name, stage in cp.STAGES:
        out = written(stage(spark, at, SF), f"test-{name}")
        seen.append((at.collect(), out.collect()))
        at = out
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "source_mixing", "token_shards"]
    for before, after in seen[:-1]:
        assert after[0].asDict().keys() == docs.first().asDict().keys()
    before, after = seen[0]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in after) == sorted((i, t, len(t)) for i, t, _ in quality([(r.doc_id, r.text, r.source) for r in before]))
    before, after = seen[1]
    root = brute_components([simhash_of(r.text) for r in before])
    first = {}
    for r in before:
        p = root[simhash_of(r.text)]
        first[p] = min(first.get(p, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(first.values())
    before, after = seen[2]
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r.doc_id for r in before if any(i in " ".join(r.text.split()) for i in items)}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} >= held
    before, after = seen[3]
    times = Counter(r.doc_id for r in after)
    assert times == Counter({i: n for i, n in mixture([(r.doc_id, r.text, r.source) for r in before]).items() if n})
    before, after = seen[4]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    starts = sorted((r.start, r.n_tokens) for r in after)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_repeated_rows_and_nulls(spark):
    import corpus_pipeline as cp

    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "a", 0), (1, text, "a", 0), (2, text, "b", 0), (None, text, "a", 0), (3, None, None, 0), (4, " ".join(f"other{i}" for i in range(90)), None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    kept = cp.quality_rules(spark, docs, SF)
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, 2, None, 4])
    single = cp.simhash_dedup(spark, kept, SF)
    assert sorted(r.doc_id for r in single.collect()) == [1, 4]
    mixed = cp.source_mixing(spark, single, SF)
    assert mixed.columns == docs.columns
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_lines_go_from_the_texts(spark):
    import corpus_pipeline as cp

    own = lambda i: " ".join(chr(97 + i % 26) * (i // 26 + 1) + chr(97 + k % 26) * (k // 26 + 1) for k in range(60))
    rows = [(i, f"One notice of all\n{own(i)}", "h", 0, i) for i in range(30)] + [(99, own(99), "h", 0, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, lost long")
    got = {r.doc_id: r for r in cp.quality_rules(spark, docs, SF).collect()}
    assert all(got[i].text == own(i) and got[i].n_chars == len(own(i)) and got[i].lost == i for i in range(30)) and got[99].n_chars == 0
