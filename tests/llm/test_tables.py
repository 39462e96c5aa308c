"""The prefix trie, the manifest and the url rules against brute-force versions, with the awkward cases in their tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import duck, same
from tidemark.llm import manifest, prefix_trie, queries, url_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_manifest", "op13_url_rules"])
def test_query_against_sql(spark, name):
    same(queries.queries()[name](spark, SF).toPandas(), duck(SF).sql(queries.oracle_sql()[name]).df())


def step(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16]


def conversations(rows, graft):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, step(role, text), role or "", text or ""))
    own = {c: [y[3:] for y in sorted(v)] for c, v in by.items()}
    if not graft:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}


def nodes(of):
    members, kids, leaves, saved, out = defaultdict(list), defaultdict(list), {}, {}, Counter()
    for c, turns in of.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + (len(members[n]) - 1) * (len(WORD.findall(n[-1][1])) if n else 0)
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(of[c]) == len(n))))
        out[(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


NODE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


@pytest.mark.parametrize("graft,least", [(False, 2), (False, 10**6), (True, 2), (True, 64)])
def test_trie(spark, graft, least):
    rng, rows = random.Random(2), []
    for c in range(200):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["u", "a", None]) if t % 2 else "u", rng.choice(["hi", "hi", "", "x y\x0bz", None])))
    rows += [(1000 + i, t, "u", f"same {t}") for i in range(150) for t in range(4)]  # a large group of copies
    rows += [(7, 0, "u", "again")] * 3 + [(None, 0, "u", "lost")] + [(5000, t, "u", f"{t % 3} " * (1 + 20000 * (t == 9))) for t in range(1500)]
    table = spark.createDataFrame([(*r, 1, b"x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth long, prefix binary, words long").repartition(5)
    steps = prefix_trie.steps(table)
    got = prefix_trie.trie(prefix_trie.grafted(steps) if graft else steps, least_shared=least)
    assert Counter(tuple(r) for r in got.select(*NODE).collect()) == nodes(conversations(rows, graft))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(prefix_trie.grafted(prefix_trie.steps(none))).count() == 0


def test_ends_in_pieces(spark):
    ids = spark.range(-300, 4000).select(F.lit(b"k" * 16).alias("prefix"), F.col("id").alias("conv_id"))
    (row,) = prefix_trie._ends(ids, piece=50).collect()
    assert row["ends_sha256"] == hashlib.sha256(",".join(map(str, range(-300, 4000))).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
def test_slots_are_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 2**63, (n, 2)).astype(np.uint64)
    slots = prefix_trie.Slots(keys)
    assert sorted(slots.of(keys)) == list(range(n))
    assert (slots.of(keys + np.uint64(1)) == -1).all()


H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def climbed(tree, i, now):
    """Siblings on the way up from place i, and the root with ``now`` in that place."""
    siblings = []
    for level in tree[:-1]:
        run = level[i // 3 * 3 :][:3]
        siblings += run[: i % 3] + run[i % 3 + 1 :]
        now, i = H("".join([*run[: i % 3], now, *run[i % 3 + 1 :]])), i // 3
    return siblings, now


def proofs(rows):
    by, out = defaultdict(list), Counter()
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    if not rows:
        return out
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    ranked = {s: sorted(by[s], key=lambda x: x[:3]) for s in names}
    trees = {s: levels([x[2] for x in ranked[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    root = top[-1][0]
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(ranked[s]):
            altered = r[1].replace("\n", "") if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            a, now = climbed(trees[s], i, leaf(r, altered))
            b, now = climbed(top, k, now)
            out[(r[0], own, trees[s][-1][0], root, H("".join(a + b)), now, now == root)] += 1
    return out


def manifest_rows(docs, **more):
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest.folded(manifest.manifest(docs, **more, altered=manifest.leaf(docs, text=altered)), "altered")
    x = lambda c: F.lower(F.hex(c)).alias(c)
    return rows.select("doc_id", x("digest"), x("subroot"), x("root"), F.sha2(F.lower(F.hex("path")), 256), x("folded_root"), F.col("folded_root") == F.col("root"))


@pytest.fixture(scope="module")
def leaves():
    rng = random.Random(3)
    return [(i * rng.randint(1, 300) - 500 + i, rng.choice(["a\nb", "x", "", None, "y\n\n", "long\n" * 50000]), "en", rng.choice(["s", "ü", "a", None, "s", "s"]), i % 5, "q", 9) for i in range(300)]


@pytest.mark.parametrize("case", ["distinct", "blocks", "ties", "one", "none"])
def test_manifest(spark, leaves, case):
    rows = list({r[0]: r for r in leaves}.values())
    if case == "ties":
        rows = [*leaves, *leaves[:40], *leaves[:10], *[(None, f"t{i % 4}", "en", [None, "a"][i % 2], None, "", 1) for i in range(30)], *[(7, f"t{i}", None, "a", 1, "", 2) for i in range(20)], (None, None, None, "only", None, None, None)]
    if case in ("one", "none"):
        rows = [(1, "x\n", "e", "s", 1, "", 3)][: case == "one"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, g long").repartition(3)
    got = manifest_rows(docs, **({"levels": 1} if case == "blocks" else {}))
    assert Counter(tuple(r) for r in got.collect()) == proofs(rows)


def test_ranks():
    ids = np.sort(np.random.default_rng(1).choice(1 << manifest.CHUNK, 3000, replace=False))
    bits = np.zeros(1 << manifest.CHUNK, bool)
    bits[ids] = True
    packed = manifest.zstandard.ZstdCompressor().compress(np.packbits(bits, bitorder="little").tobytes())
    every = np.arange(1 << manifest.CHUNK)
    assert (manifest.ranks(packed, every) == np.searchsorted(ids, every)).all()


def az(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = az(host)
    fit = []
    for h, p, v in rules:
        if None not in (h, p, v) and not re.search("[/?#]", h) and (not p or p[0] == "/") and path.startswith(p) and (host == az(h) or host.endswith("." + az(h))):
            fit.append((len(h + p), len(h), az(h) + p, v))
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(1)
    host = lambda: ".".join(rng.choice(["a", "b", "com", "ex", "www", ""]) for _ in range(rng.randint(1, 4)))
    path = lambda: rng.choice(["", "/"]) + "/".join(rng.choice(["en", "e", "fr", "é", "x/"]) for _ in range(rng.randint(0, 3)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(60)] + [(None, "/", "block"), ("com", None, "allow"), ("a/b", "/", "block"), ("b", "/", None), ("Com", "/", "block")]
    urls = [rng.choice(["http://", "HTTPS://", "", "x://y://"]) + host().upper() + path() + rng.choice(["", "?q=/a", "#x://z"]) for _ in range(400)]
    urls += [None, "", "://", "http://a.com", "\nhttp://a.com/\n/x?", "http://" + "a." * 30000 + "com/" + "en/" * 30000, "x" * 200000, "http://hot.com/en", *["http://hot.com/en"] * 200]
    rows = [(i if i % 7 else None, x, "h", "clash", "v") for i, x in enumerate(urls + urls[:50])]
    pages, table = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    got = Counter(tuple(r) for r in url_rules.judge(pages, table).collect())
    assert got == Counter((i, *verdict(x, rules)) for i, x, *_ in rows)
    assert url_rules.judge(pages.limit(0), table).count() == 0
    assert {(r.rule, r.verdict) for r in url_rules.judge(pages, table.limit(0), default="block").collect()} == {(None, "block")}
