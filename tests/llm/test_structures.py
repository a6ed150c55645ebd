"""License scans, Merkle manifests and conversation tries against plain versions."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import conversations, licenses, merkle, ordering, queries

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def write(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# Positions.


def test_ranked_spreads_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 50)
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice(["a", None, "b"]), rng.choice([None, *range(40)]), i) for i in range(900)]
    rng.shuffle(rows)
    got = ordering.ranked(spark.createDataFrame(rows, "g string, o int, i long"), ["g"], ["o", "i"], "t").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    want = {(g, r[2]): (k, len(each)) for g, each in groups.items() for k, r in enumerate(sorted(each, key=lambda r: (r[1] is not None, r[1] or 0, r[2])))}
    assert {(r.g, r.i): (r["at"], r.n) for r in got} == want


# Licenses.


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or "")) if w]


def plain_scan(text):
    w = words(text)
    places = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p, label in licenses.PHRASES}
    every = sorted(i for x in places.values() for i in x)
    found, best = set(), 0.0
    for label, body in licenses.TEMPLATES:
        t = words(body)
        h = max(8, 1 << (len(t) - 1).bit_length())
        for s in range(0, len(w), h):
            share = len(set(t) & set(w[s : s + 2 * h])) / len(set(t))
            if share >= 0.8:
                found.add(label)
                best = max(best, share)
    base = {label for label, x in places.items() if x}
    return len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if every else best


def damaged(text, rng, share):
    return " ".join(w if rng.random() > share else rng.choice(["qux", "the", "", w.upper(), "software"]) for w in text.split())


def license_texts():
    rng = random.Random(5)
    filler = ["the", "software", "Ångström", "of", "license", "permission", "notice", "x1", "mit", "general", "public", "apache", "copy", "file", "\n", "..."]
    texts = [None, "", " \n\t", "MIT license mit LICENSE", "the GNU General\nPublic\tLicense", "Apache-License", "mıt license", "mit license", "MITKLicense mit license", "İMIT License"]
    for k in range(120):
        label, body = rng.choice(licenses.TEMPLATES)
        fill = lambda n: " ".join(rng.choice(filler) for _ in range(n))
        texts.append(f"{fill(rng.randrange(60))} {damaged(body, rng, rng.choice([0, 0.05, 0.15, 0.25, 0.4]))} {fill(rng.randrange(60))}")
    return texts + texts[3:6]


def test_license_scan_equals_every_window(spark, tmp_path):
    texts = license_texts()
    docs = spark.createDataFrame([(i // 2 if i % 7 else None, None, None, None, t) for i, t in enumerate(texts)], DOCS)
    got = queries.op11_license_scan(spark, write(spark, tmp_path, documents=docs.withColumn("row", F.lit(1)).withColumn("words", F.lit("x"))))
    keyed = sorted(map(repr, (tuple(r)[1:] for r in got.collect())))
    assert keyed == sorted(repr(plain_scan(t)) for t in texts)
    assert {r.labels for r in got.collect()} > {"", "mit", "bsd", "isc"}


def test_license_scan_of_long_texts_and_empty_tables(spark):
    body = licenses.TEMPLATES[9][1]
    text = "filler words here " * 300_000 + body + " more" * 100_000
    start = time.time()
    rows = licenses.license_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {r.label for r in rows} == {"mit"} and min(r.start for r in rows) <= 900_000 <= max(r.start + r.n_block for r in rows)
    assert time.time() - start < 60
    assert licenses.summed(licenses.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_prefix_filter_loses_nothing_whatever_the_order(spark):
    rng = random.Random(9)
    named = sorted({w for _, t in licenses.TEMPLATES for w in words(t)})
    for _ in range(3):
        counts = {w: rng.randrange(50) for w in named}
        for t in licenses.ordered_templates(licenses.TEMPLATES, counts, 0.8):
            for _ in range(50):
                some = set(rng.sample(t.words, t.least))
                assert some & set(t.prefix)
            assert t.least / len(t.words) >= 0.8 > (t.least - 1) / len(t.words)


# Merkle trees.


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, fanout):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i : i + fanout])) for i in range(0, len(found[-1]), fanout)])
    return found


def sides(found, at, fanout):
    out = []
    for nodes in found[:-1]:
        first = at - at % fanout
        run = nodes[first : first + fanout]
        out.append(("".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])))
        at //= fanout
    return out


def plain_manifest(rows, fanout=16):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r, leaf(r)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(by[s], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for s in names}
    trees = {s: levels([h for _, h in ordered[s]], fanout) for s in names}
    over = levels([trees[s][-1][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for i, (r, h) in enumerate(ordered[s]):
            path = sides(trees[s], i, fanout) + sides(over, k, fanout)
            node = h
            if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], lower(r[4])))
            for b, a in path:
                node = sha(b + node + a)
            out.append((r[0], h, trees[s][-1][0], over[-1][0], sha("".join(b + a for b, a in path)), node, node == over[-1][0]))
    return sorted(map(repr, out))


def manifest_rows(n, sources):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(3 * n)]), rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice([None, "", f"Text É {i}", f"text {i}"])) for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize(("n", "sources"), [(1, ["a"]), (17, [None]), (60, ["b", "é", "Z", None]), (400, ["hot"] * 30 + [f"s{i}" for i in range(40)])])
def test_manifest_equals_plain_trees(spark, tmp_path, monkeypatch, n, sources):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 40)
    rows = manifest_rows(n, sources)
    docs = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit(3)).withColumn("a.b", F.lit(1)).withColumn("hash", F.lit("x"))
    got = queries.op12_merkle_manifest(spark, write(spark, tmp_path, documents=docs))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_manifest(rows)


def test_binary_manifest_pairs_by_xor(spark):
    rows = manifest_rows(23, ["a", "b", "c"])
    found = merkle.manifest(spark.createDataFrame(rows, DOCS), fanout=2)
    got = found.select(merkle.hexed(F.col("root")).alias("r"), merkle.folded(F.col("leaf"), F.col("path")).alias("f")).distinct().collect()
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    tops = [levels([leaf(r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))], 2)[-1][0] for s in sorted(by)]
    assert [(r.r, r.f) for r in got] == [(levels(tops, 2)[-1][0],) * 2]


def test_manifest_of_nothing(spark, tmp_path):
    assert queries.op12_merkle_manifest(spark, write(spark, tmp_path, documents=spark.createDataFrame([], DOCS))).count() == 0


# Conversations.


def plain_trie(rows):
    original = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            original[c].append(((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}")), (role, text)))
    original = {c: [x for _, x in sorted(each)] for c, each in original.items()}
    whole = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(original.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = sha(",".join(str(c) for c in sorted(members[p]) if whole[c] == p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], ends))
    return sorted(map(repr, out))


def chat(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        length = rng.choice([0, 1, 2, 3, 5, 9, 14, 30])
        same = rng.random() < 0.3
        for t in range(length):
            text = f"hot {t}" if same else rng.choice(["hi", None, "", "né", f"own {rng.randrange(3)}"])
            rows.append((rng.choice([c, c, c, c, None]) if rng.random() < 0.05 else c, rng.choice([t, None]) if rng.random() < 0.05 else t, rng.choice(["user", "bot", None]), text))
    long = [(n + 7, t, "user", f"hot {t}" if t < 20 else f"long {t}") for t in range(300)]
    star = [(1000 + c, t, "user", "hot 0" if t == 0 else f"leaf {c} {t}") for c in range(60) for t in range(3)]
    rows += long + star + rows[:5]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("least", [1, 7, 1 << 20])
def test_trie_equals_plain_version(spark, monkeypatch, least):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)
    monkeypatch.setattr(conversations, "PACK_IDS", 3)
    rows = chat(least, 60)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).withColumn("item", F.lit("x"))
    got = conversations.prefix_trie(table, block=4, least=least).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless(spark, tmp_path):
    kinds = "conv_id int, turn int, role string, text string"
    assert queries.op13_conversation_trie(spark, write(spark, tmp_path, conversations=spark.createDataFrame([], kinds))).count() == 0
    short = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:4]  # the first is all they have, and no base is there
    rows = [(c, None, None, None) for c in short]
    got = conversations.prefix_trie(spark.createDataFrame(rows, kinds)).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_trie(rows) and len(got) == 1


def test_centroids_halve_and_sum(spark):
    rng = np.random.default_rng(3)
    for shape in ("chain", "star", "random", "deep"):
        n = 500
        parent = np.array([-1] + [{"chain": i - 1, "star": 0, "random": int(rng.integers(i)), "deep": int(rng.integers(max(0, i - 3), i))}[shape] for i in range(1, n)])
        depth = np.zeros(n, dtype=np.int64)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        own, leaves, saved = (rng.integers(1, 5, n) for _ in range(3))
        sums = [x.astype(np.int64).copy() for x in (own, leaves, saved)]
        for i in range(n - 1, 0, -1):
            for x in sums:
                x[parent[i]] += x[i]
        a, b = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        rounds = conversations.decomposed(parent.copy(), np.zeros(n, dtype=np.int64), depth, sums[0].copy(), leaves, saved, a, b)
        assert (a == sums[1]).all() and (b == sums[2]).all()
        assert rounds <= np.log2(own.sum()) + 1
