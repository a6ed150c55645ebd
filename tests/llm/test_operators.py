"""Each operator against a brute-force version, an exact round trip or planted cases, with the edge cases."""

import collections
import hashlib
import math
import random
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm import byte_bpe, decontaminate, exact_dedup, language, line_dedup, lm, quality, simhash, simhash_similar, token_files, toxicity
from panelforge.llm.graph import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: The columns that results and intermediates use, as extra columns of the input.
CLASH = "score double, n_tokens long, ids string, fp long, kept boolean, word string, c int, label int"
EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Same  text here"), (6, "Same text\nhere"), (None, "no id"), (7, "A b c d e f g " * 3000)]


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in CLASH.split(", ")))


@pytest.fixture(scope="module")
def edges(spark):
    return docs_of(spark, EDGES)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


class TestByteBpe:
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})

    def test_as_the_library(self):
        rng = random.Random(0)
        parts = ["a", "b", "aa", "the", "é", " ", "  ", "\n", "\x1c", "\x85", "　", "1", "$", "'s", "ing", "日本", "\x00", "ſ"]
        for _ in range(1500):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
            assert byte_bpe.encode_text(text, RANKS, public_tokenizers.PATTERN).tolist() == self.enc.encode_ordinary(text)

    def test_appends_and_edits(self):
        encoder = byte_bpe.PrefixEncoder(byte_bpe.load_ranks(RANKS))
        rng = random.Random(1)
        table = byte_bpe.PrefixTable(encoder, b"hello")
        for _ in range(150):
            new = bytes(rng.choice(b"abc eth") for _ in range(rng.randint(0, 6)))
            if rng.random() < 0.5:
                table.append(new)
            else:
                at = rng.randint(0, len(table.data))
                table.edit(at, min(len(table.data), at + rng.randint(0, 5)), new)
            assert table.last == encoder.extend(table.data, [])

    def test_round_trip(self, edges, empty):
        coded = byte_bpe.decode_documents(byte_bpe.encode_documents(edges, RANKS, public_tokenizers.PATTERN), RANKS)
        found = {r.doc_id: r for r in coded.withColumn("sha", byte_bpe.ids_sha256(F.col("ids"))).collect()}
        for doc, text in EDGES:
            ids = self.enc.encode_ordinary(text or "")
            assert found[doc].ids == ids and bytes(found[doc].decoded) == (text or "").encode()
            assert found[doc].sha == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert byte_bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


class TestSimHash:
    @staticmethod
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    def brute(self, rows):
        fps = [self.fingerprint(t) for _, t in rows]
        label = list(range(len(rows)))
        for _ in rows:
            for i in range(len(rows)):
                for j in range(i):
                    if (fps[i] ^ fps[j]).bit_count() <= 3:
                        label[i] = label[j] = min(label[i], label[j])
        least = {}
        for (doc, _), x in zip(rows, label, strict=True):
            least[x] = min((d for d in (least.get(x), doc) if d is not None), default=None)
        return [(doc, fp, least[x]) for (doc, _), fp, x in zip(rows, fps, label, strict=True)]

    @pytest.mark.parametrize("shard_rows", [8192, 2])
    def test_brute_force(self, spark, shard_rows):
        rng = random.Random(2)
        base = words(rng, 400).split()
        rows = [e for e in EDGES if e[0] != 7] + [(10, None), (11, "one")]
        for i in range(40):
            copy = list(base)
            for _ in range(i % 4):
                copy[rng.randrange(len(copy))] = "x"
            rows.append((100 - i, " ".join(copy)))
        rows += [(200 + i, words(rng, 30)) for i in range(15)] + [rows[5]]
        found = simhash.near_dedup(docs_of(spark, rows), shard_rows=shard_rows)
        got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found.collect()]
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted(got, key=key) == sorted(self.brute(rows), key=key)

    def test_crowded_shards_are_dealt_again(self):
        rng = np.random.default_rng(3)
        near = np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 30, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 30, 200).astype(np.uint64))
        fps = np.unique(near).view(np.int64)
        shard = np.full(len(fps), (10 << 25) | 5)  # the last pair of blocks
        seen = collections.defaultdict(set)
        for rows, keys in simhash.second_keys(shard, fps):
            for i, k in zip(rows.tolist(), keys.tolist(), strict=True):
                seen[k].add(i)
        together = {(a, b) for of in seen.values() for a in of for b in of if a < b}
        for a in range(len(fps)):
            for b in range(a + 1, len(fps)):
                if int(fps[a] ^ fps[b]).bit_count() <= 3:
                    assert (a, b) in together

    def test_components(self, spark):
        links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 101)], "a long, b long")
        found = {r.node: r.root for r in components(links).collect()}
        assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}

    def test_empty(self, empty):
        assert simhash.near_dedup(empty).count() == 0


class TestSimilarTexts:
    @staticmethod
    def brute(rows):
        texts = [(t or "").lower().split() for _, t in rows]
        sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in texts]
        label = list(range(len(rows)))
        for _ in range(len(rows)):
            before = list(label)
            for i in range(len(rows)):
                for j in range(i):
                    same = texts[i] == texts[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
                    if same:
                        label[i] = label[j] = min(label[i], label[j])
            if before == label:
                break
        least = {}
        for (doc, _), x in zip(rows, label, strict=True):
            least[x] = min((d for d in (least.get(x), doc) if d is not None), default=None)
        return [(doc, least[x]) for (doc, _), x in zip(rows, label, strict=True)]

    @pytest.mark.parametrize("shard_rows", [4096, 3])
    def test_brute_force(self, spark, shard_rows):
        rng = random.Random(9)
        rows = [e for e in EDGES if e[0] != 7] + [(10, None), (11, "ONE")]
        for n in (6, 9, 30, 120):
            base = words(rng, n).split()
            for i in range(25):
                copy = list(base)
                for _ in range(rng.randrange(1 + n // 20)):
                    copy[rng.randrange(n)] = rng.choice(["x", "y z"])
                rows.append((1000 * n + i, " ".join(copy[: n - rng.randrange(2)])))
        rows += [(200 + i, words(rng, 30)) for i in range(15)] + [rows[5]]
        found = [(r.doc_id, r.component_id) for r in simhash_similar.near_dedup(docs_of(spark, rows), shard_rows=shard_rows).collect()]
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted(found, key=key) == sorted(self.brute(rows), key=key)
        assert len({c for _, c in found}) < len(rows) / 2

    def test_repeated_lines(self, spark):
        """A line repeated many times leaves the set of shingles nearly the same."""
        rng, rows = random.Random(10), []
        for i in range(30):
            base = words(rng, 200, 5000).split()
            rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + base[50:60] * 40))]
        found = [(r.doc_id, r.component_id) for r in simhash_similar.near_dedup(docs_of(spark, rows)).collect()]
        assert sorted(found) == sorted(self.brute(rows)) == [(i, i - i % 2) for i in range(60)]

    def test_empty(self, empty):
        assert simhash_similar.near_dedup(empty).count() == 0


class TestDecontamination:
    @staticmethod
    def shingles(text):
        w = decontaminate.words_of(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    @pytest.mark.parametrize("block_chars, item_type", [(10**6, "long"), (400, "int"), (10**6, "string")])
    def test_brute_force(self, spark, empty, block_chars, item_type):
        rng = random.Random(4)
        items = [(i, words(rng, 5 + i)) for i in range(40)] + [(90, None), (91, "one"), (92, ""), (93, "one"), (None, words(rng, 9))]
        rows = [e for e in EDGES]
        for i, text in items[:40]:
            w = text.split()
            for k in range(0, len(w), 9):
                w[k] = "changed" if i % 2 else w[k]
            rows.append((1000 + i, " ".join([words(rng, 300), *w, words(rng, 200)])))
        rows.append((2000, f"x {items[-1][1]} y"))
        bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item_id", F.col("item_id").cast(item_type))
        found = decontaminate.contained_items(docs_of(spark, rows), bench, block_chars=block_chars).withColumn("item_id", F.col("item_id").cast("long")).collect()
        found = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in found}
        expected = {}
        for doc, text in rows:
            have = self.shingles(text)
            for item, t in items:
                s = self.shingles(t)
                if s and len(s & have) >= 0.8 * len(s) - 1e-9:
                    expected[doc, item] = (len(s), len(s & have))
        assert found == expected and len(expected) > 20 and (2000, None) in expected
        assert decontaminate.contained_items(empty, bench).count() == 0
        assert decontaminate.contained_items(docs_of(spark, rows), bench.limit(0)).count() == 0

    def test_pipeline_drops_null_ids_too(self, spark, tmp_path):
        item = words(random.Random(13), 20)
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        docs = docs_of(spark, [(None, f"before {item} after"), (1, f"x {item}"), (2, "clean text")])
        assert [r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path)).collect()] == [2]


class TestExactDedup:
    def test_groups(self, spark, empty):
        rows = [*EDGES, (50, "hot  text"), (49, "hot text"), *((60 + i, "hot\ttext") for i in range(300)), (4, "one")]
        found = exact_dedup.exact_dedup(docs_of(spark, rows)).collect()
        same = collections.defaultdict(list)
        for doc, text in rows:
            import re

            same[re.sub("[ \t-\r]+", " ", text or "")].append(doc)
        by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in same.items()}
        assert len(found) == len(rows)
        for r in found:
            ids = by[r.text_sha256]
            keep = min((i for i in ids if i is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
        assert exact_dedup.exact_dedup(empty).count() == 0


class TestLanguage:
    def test_learns(self, spark, empty):
        rng = random.Random(5)
        of = {"xx": "abcdefg", "yy": "nopqrst"}
        rows = [(i, " ".join("".join(rng.choice(of[lang]) for _ in range(5)) for _ in range(20)), lang) for i in range(80) for lang in of]
        df = spark.createDataFrame([(2 * i + (lang == "yy"), t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
        model = language.fit(df, per_language=30)
        edge = docs_of(spark, [*EDGES, (8, "12 !")])
        found = {r.doc_id: r for r in language.predict(edge, model).collect()}
        assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 3, 8)) and found[4].lang_pred in of
        assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in language.predict(df, model).join(df, "doc_id").collect())
        assert language.fit(df.limit(0)) is None
        assert {r.lang_pred for r in language.predict(edge, None).collect()} == {"und"} and language.predict(empty, model).count() == 0


class TestClassifiers:
    def test_toxicity_needs_the_pair(self, spark, edges, empty):
        """Two terms that are harmless alone are learned as a pair."""
        rng = np.random.default_rng(6)
        a, b = rng.random((2, 4000)) < 0.5
        rows = [np.array([t for t, on in enumerate((x, y, True)) if on]) for x, y in zip(a, b, strict=True)]
        y = (a & b).astype(float)
        model = toxicity.train(rows, [11, 12, 13], y)
        assert ((model.score(rows) >= 0.5) == (y == 1)).all()
        assert {r.score for r in toxicity.score(edges, None).collect()} == {0.0} and toxicity.score(empty, model).count() == 0

    def test_toxicity_on_texts(self, spark, edges):
        rng = random.Random(7)
        rows = [(i, words(rng, 30) + (" vile" if i % 5 == 0 else "")) for i in range(400)]
        labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
        model = toxicity.fit(docs_of(spark, rows), labels)
        found = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, rows), model).collect()}
        assert all((s >= 0.5) == (i % 5 == 0) for i, s in found.items())
        assert all(0 <= r.score <= 1 for r in toxicity.score(edges, model).collect())

    def test_quality(self, spark, edges, empty):
        rng = random.Random(8)
        rows = [(i, words(rng, 60) if i % 4 else "spam " * 50) for i in range(400)]
        labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
        model = quality.fit(docs_of(spark, rows), labels)
        found = {r.doc_id: r.score for r in quality.score(docs_of(spark, rows), model, keep=["doc_id"]).collect()}
        assert all((s >= 0.5) == (i % 4 > 0) for i, s in found.items())
        kept = quality.score(edges, model, score_col="__s")
        assert kept.columns == [*edges.columns, "__s"] and all(0 <= r["__s"] <= 1 for r in kept.collect())
        assert quality.fit(docs_of(spark, rows), labels.where("quality = 1")) is None
        assert {r.score for r in quality.score(edges, None, keep=["doc_id"]).collect()} == {1.0} and quality.score(empty, model).count() == 0

    def test_quality_is_learned_from_all_pairs(self, spark):
        """The weights are where the gradient of the mean loss of all pairs is zero, also where labels contradict the texts."""
        rng = random.Random(9)
        rows = [(i, words(rng, rng.randint(5, 60)) + (" !!! $$$" * rng.randint(0, 9) if i % 3 == 0 else "")) for i in range(500)]
        labelled = [(i, int(i % 3 > 0) if i % 10 else rng.randint(0, 1)) for i in range(500)]
        model = quality.fit(docs_of(spark, rows), spark.createDataFrame(labelled, "doc_id long, quality int"))
        y, x = np.array([q for _, q in labelled]), np.stack([quality.features(t) for _, t in rows])
        assert model.cuts == pytest.approx(np.quantile(x, quality.QUANTILES, axis=0).T)
        coded = model.coded(x)
        raw = coded @ model.weights
        lacking = 1 / (1 + np.exp(raw[y == 1][:, None] - raw[y == 0]))
        pairs = (y == 1).sum() * (y == 0).sum()
        gradient = (lacking.sum(axis=0) @ coded[y == 0] - lacking.sum(axis=1) @ coded[y == 1]) / pairs + 1e-3 * model.weights
        assert np.abs(gradient).max() < 1e-4
        assert model.threshold == pytest.approx(np.quantile(raw, (y == 0).mean())) and model.scale == pytest.approx(raw.std() / 2)

    def test_quality_is_learned_from_all_rows(self, spark):
        rows = [(i, f"a{i % 7} " * (1 + i % 5) + "b" * (1 + i % 211) + "!" * (i % 3)) for i in range(21_000)]
        labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(21_000)], "doc_id long, quality int")
        model = quality.fit(docs_of(spark, rows), labels)
        x = np.stack([quality.features(t) for _, t in rows])
        assert model.cuts == pytest.approx(np.quantile(x, quality.QUANTILES, axis=0).T)
        raw = model.coded(x) @ model.weights
        assert model.threshold == pytest.approx(np.quantile(raw, 1 / 3)) and model.scale == pytest.approx(raw.std() / 2)


class TestLineDedup:
    @staticmethod
    def patterns(line):
        """The line's templates: its tokens with some of them generalised."""
        tokens = ["<*>" if any(c.isdigit() for c in t) else t for t in line.split()]
        n = len(tokens)
        cut = lambda size: [range(at, min(at + size, n)) for at in range(3, n, size)] if size else []
        pairs = [[*a, *b] for i, a in enumerate(cut(n // 10)) for b in cut(n // 10)[i + 1 :]]
        return list(dict.fromkeys(tuple(None if i in wild else t for i, t in enumerate(tokens)) for wild in [[], *cut(n // 5), *pairs]))

    def brute(self, rows):
        at = collections.defaultdict(set)
        for doc, text in rows:
            for n, line in enumerate((text or "").split("\n")):
                for t in self.patterns(line) if line.strip() else ():
                    at[t].add((doc is None, doc or 0, n))
        docs = {t: len({x[:2] for x in places}) for t, places in at.items()}
        recurs = {t for t, n in docs.items() if n >= 3 or n == 2 and len(t) >= 10 and None not in t}
        for doc, text in rows:
            keep = []
            for n, line in enumerate((text or "").split("\n")):
                hot = [t for t in self.patterns(line) if t in recurs] if line.strip() else []
                if all(min(at[t]) == (doc is None, doc or 0, n) for t in hot):
                    keep.append(line)
            yield doc, None if text is None else "\n".join(keep)

    @pytest.mark.parametrize("hot", [line_dedup.HOT, 20])
    def test_brute_force(self, spark, empty, monkeypatch, hot):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        rng = random.Random(9)
        name = lambda: rng.choice(["ann", "eve", "dan", "kim", "lee", "sue", "tom", "zoe"])
        plain = ["the same line of ten words is in many texts", "short", "id 12 was seen by user {a} on day 7 again", "mail of the day went to {a} and a copy to {b} at noon"]
        rows = [(1, None), (2, ""), (None, "short\nown line here"), (3, "\n\n")]
        for i in range(40):
            line = rng.choice(plain).replace("12", str(i)).format(a=name(), b=name())
            rows.append((10 + i, f"{words(rng, 12)}\n{line}\n{line}"))
        rows.append(rows[-1])
        found = line_dedup.line_dedup(docs_of(spark, rows).withColumns({"__row": F.lit(1), "__drop": F.lit("x"), "doc": F.lit(2)})).collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in found) == sorted((d or 0, t or "") for d, t in self.brute(rows))
        assert sum(r["__n_dropped"] for r in found) > 60 and {(r["__row"], r["__drop"], r.doc) for r in found} == {(1, "x", 2)}
        assert line_dedup.line_dedup(empty).count() == 0

    def test_two_variable_fields(self, spark):
        line = "dear {} we thank you for the order of {} and hope to see you again in our shop very soon"
        rows = [(i, line.format("reader", a).replace("see you", f"see {b}")) for i, (a, b) in enumerate([("shoes", "him"), ("books", "her"), ("lamps", "them")])]
        found = {r.doc_id: r.text for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
        assert found == {0: rows[0][1], 1: "", 2: ""}

    def test_a_long_line_recurs_in_two(self, spark):
        line = " ".join(f"word{chr(97 + i)}" for i in range(12))
        found = line_dedup.line_dedup(docs_of(spark, [(1, f"{line}\nshort"), (2, f"own\n{line}"), (3, "short")]))
        assert {r.doc_id: r.text for r in found.collect()} == {1: f"{line}\nshort", 2: "own", 3: "short"}

    def test_keys_are_equal_as_patterns_are(self):
        rng = random.Random(14)
        lines = [" ".join(rng.choice("ab") if rng.random() < 0.1 else "x" for _ in range(rng.choice([4, 7, 12, 23]))) for _ in range(120)]
        keyed = collections.defaultdict(set)
        for line in lines:
            tokens = line_dedup.parse(line)
            hashes = np.array([xxhash.xxh64_intdigest(t, i) for i, t in enumerate(tokens)], dtype=np.uint64)
            wild = [[i for run in w for i in run] for w in line_dedup.wildcards(len(tokens))]
            patterns = [tuple(None if i in w else t for i, t in enumerate(tokens)) for w in wild]
            assert set(patterns) == set(self.patterns(line)[1:]) and all(len(w) <= 0.2 * len(tokens) for w in wild)
            for key, pattern in zip(line_dedup.template_keys(hashes, line_dedup.leaf_of(tokens, 3), 3).tolist(), patterns, strict=True):
                keyed[key].add(pattern)
        assert all(len(p) == 1 for p in keyed.values()) and len(keyed) == len(set().union(*keyed.values()))


class TestTokenFiles:
    def test_as_the_library(self):
        rng = random.Random(10)
        parts = ["a", "B", "the", "É", "é", "́", " ", "\n", "\x1c", "\xa0", "1", "$", "'s", "<|endoftext|>", "日", "ſ", "İ", "Σ", "x</w>", ","]
        plain, encoder = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS, "<u2")
        for _ in range(1500):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
            ids = np.frombuffer(encoder.encode_batch([text], 1)[0], "<u2").tolist()
            assert ids == [*plain.encode(text, add_special_tokens=False).ids, 1]

    def test_files(self, spark, empty, tmp_path):
        rows = [(r if r is not None else 99, t) for r, t in EDGES]
        folder = f"file://{tmp_path}/files"
        manifest = token_files.write_token_files(docs_of(spark, rows), WORDS, folder, 1, length=16)
        found = token_files.read_token_files(manifest, folder).orderBy("start").collect()
        plain, position = Tokenizer.from_file(WORDS), 0
        for (doc, text), r in zip(sorted(rows), found, strict=True):
            ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
            assert (r.doc_id, r.start, r.n_tokens) == (doc, position, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            position += len(ids)
        for part in manifest.collect():
            file = token_files.SequenceFile(f"{folder}/sequences", part.file)
            n = file.batches.num_record_batches
            masks = [file.sequence(i)[1] for i in range(sum(file.batches.get_batch(b).num_rows for b in range(n)))]
            assert sum(int(m.sum()) for m in masks) == part.n_tokens and all(len(m) == 16 for m in masks)
        assert token_files.token_file_index(empty, WORDS, 1).count() == 0


class TestLanguageModel:
    def test_base_and_counts(self, spark):
        rows = [(i, t) for i, (_, t) in enumerate(EDGES)] + [(20 + i, "a b c a b unknown" + str(i)) for i in range(20)]
        df = docs_of(spark, rows)
        found = {r.doc_id: r for r in lm.score_texts(df, F.col("doc_id") % 3 == 0, classes=4, heavy=6).collect()}
        tokens = {d: [*(t or "").encode().lower().split(), b""] for d, t in rows}
        counts = collections.Counter(w for d, of in tokens.items() if d % 3 for w in of)
        n, v = sum(counts.values()), len(counts)
        assert len(found) == len(rows)
        for d, of in tokens.items():
            assert found[d].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in of))
            assert (found[d].n_tokens, found[d].n_known, found[d].train_tokens) == (len(of), sum(counts[w] > 0 for w in of), n)
            assert found[d].score < 0

    def test_distribution_sums_to_one(self, spark):
        counts = spark.createDataFrame([(b"", 9), (b"a", 8), (b"b", 5), (b"c", 2), (b"d", 1), (b"e", 1)], "word binary, c long")
        vocab = lm.vocabulary(counts, classes=3, heavy=5)
        model = lm.LogBilinear.start(vocab.class_counts)
        n = len(vocab.class_counts)
        p = 10 ** model.log10_classes(np.arange(n), np.tile([[n, n]], (n, 1)))
        inside = 10 ** vocab.shares(np.array([2, 1, 1, 0]))
        # Each unseen type has the last share.
        assert p.sum() == pytest.approx(1, abs=1e-5) and inside[:3].sum() + vocab.unseen_types * inside[3] == pytest.approx(1)

    def test_learns_context(self):
        rng = np.random.default_rng(11)
        counts = np.full(6, 1000.0)
        model = lm.LogBilinear.start(counts)
        noise = counts / counts.sum()
        for _ in range(400):
            before = rng.integers(0, 6, 1024)
            model.learn((before + 1) % 6, np.stack([before, before], axis=1), noise, rng, 0.1)
        p = model.log10_classes(np.array([1]), np.array([[0, 0]]))[0]
        assert p > math.log10(0.6)

    def test_words_beyond_the_first_level(self, spark):
        """Every word has a probability that its context changes; all of them and the unseen words sum to one."""
        rows = [(b"", 9000)] + [(b"w%d" % i, 40 - i // 100) for i in range(4000)] + [(b"once%d" % i, 1) for i in range(500)]
        vocab = lm.vocabulary(spark.createDataFrame(rows, "word binary, c long"), classes=50)
        assert vocab.slots.own >= 2048 and vocab.slots.hashed > 100
        rng = np.random.default_rng(12)
        model = lm.LogBilinear.start(vocab.class_counts, slots=vocab.slots)
        noise = vocab.class_counts / vocab.class_counts.sum()
        table = lm.noise_table(model.slots)
        n = len(model.context) - 1
        pairs = np.array([[vocab.unit(b"w%d" % i), vocab.unit(b"w%d" % (i + 1))] for i in range(1000, 1020)])
        hashed = np.array([[vocab.unit(b"once%d" % i), vocab.unit(b"once%d" % (i + 1))] for i in range(20)])
        pairs = np.concatenate([pairs, hashed])
        for _ in range(300):
            before, after = pairs[rng.integers(0, len(pairs), 1024)].T
            model.learn(after, np.stack([before, before], axis=1), noise, rng, 0.1, table)
        words = [w for w, _ in rows]
        units, c = np.array([vocab.unit(w) for w in words]), np.array([c for _, c in rows])
        for before, after in (pairs[3], pairs[30]):
            lp, rest = model.log10_units(units, np.full((len(units), 2), before))
            shared = units >= vocab.slots.outputs + vocab.slots.own
            lp[shared] += vocab.shares(c[shared], vocab.slots.counts[units[shared] - vocab.slots.outputs])
            assert (10**lp).sum() + vocab.unseen_types * 10 ** (rest[0] + vocab.shares(np.zeros(1))[0]) == pytest.approx(1, abs=1e-4)
            own, other = (model.log10_classes(np.array([after]), np.array([[x, x]]))[0] for x in (before, n))
            assert own > other + 1

    def test_unseen_words_are_many(self, spark):
        """One of the types that the counts lack is no likelier than a word that was seen once."""
        rows = [(b"", 900)] + [(b"w%d" % i, 50) for i in range(60)] + [(b"two%d" % i, 2) for i in range(200)] + [(b"once%d" % i, 1) for i in range(600)]
        vocab = lm.vocabulary(spark.createDataFrame(rows, "word binary, c long"), classes=20)
        assert vocab.unseen_types >= 600 * 599 / 402
        assert vocab.shares(np.zeros(1))[0] <= vocab.shares(np.ones(1))[0] + 1e-9

    def test_tokens_and_contexts(self):
        texts = ["", " ", "A b\x0bc\x1cd", None, "  \u00c9 x ", "x", "y\u0085 Z z\n\n", "a b a"]
        plain = [[*(t or "").encode().lower().split(), b""] for t in texts]
        for column in (pa.array(texts), pa.array([*texts, "tail"]).slice(0, len(texts)), pa.array(texts, pa.large_string())):
            words, tokens, first = lm.tokens_of(column)
            assert [words[i] for i in tokens] == [w for t in plain for w in t]
            assert first.tolist() == [sum(map(len, plain[:i])) for i in range(len(texts))]
            before = [[b"^", b"^", *t] for t in plain]
            found = lm.contexts_of(tokens, first, len(words))
            assert [[[*words, b"^"][i] for i in row] for row in found] == [[t[i + 1], t[i]] for t in before for i in range(len(t) - 2)]

    def test_slices_are_whole(self, monkeypatch):
        monkeypatch.setattr(lm, "SLICE", 10)
        texts = ["abcd", None, "x" * 25, "", "abcdefghij", "a"]
        runs = list(lm.slices(pa.array(texts)))
        assert [t for _, run in runs for t in run.to_pylist()] == texts and [at for at, _ in runs] == [0, 2, 3, 5]

    def test_slots_grow_with_the_counts(self, spark):
        rows = lambda k: spark.range(20 * k).select(F.col("id").cast("string").cast("binary").alias("word"), F.lit(1000 * k).cast("long").alias("c"))
        small, large = (lm.vocabulary(rows(k), classes=8).slots for k in (100, 1000))
        assert large.own >= 5 * small.own and large.hashed >= 5 * small.hashed

    def test_sums_of_rows_and_of_exponentials(self):
        rng = np.random.default_rng(14)
        at, values = rng.integers(0, 50, 400), rng.normal(size=(400, 3)).astype(np.float32)
        found, where = lm._numbered(at, 60)
        assert found.tolist() == sorted(set(at.tolist())) and (found[where] == at).all()
        assert lm._add_rows(values, where, len(found)) == pytest.approx(np.stack([values[at == k].sum(axis=0) for k in found]), abs=1e-4)
        vectors, bias, sums = rng.normal(size=(9, 3)).astype(np.float32), rng.normal(size=9).astype(np.float32), np.ones((9, 2), np.float32)
        sums[:4, 1] = 0
        # Also logits whose exponentials no float holds.
        for scale in (1, 300):
            hidden = (rng.normal(size=(20, 3)) * scale).astype(np.float32)
            logits = hidden.astype(float) @ vectors.T + bias
            # A part may be too small beside the largest term, as before; the whole never is.
            assert lm._log_sums(hidden, vectors, bias, sums[:, :1])[:, 0] == pytest.approx(np.logaddexp.reduce(logits, axis=1), rel=1e-4, abs=1e-3)
            if scale == 1:
                assert lm._log_sums(hidden, vectors, bias, sums)[:, 1] == pytest.approx(np.logaddexp.reduce(logits[:, 4:], axis=1), rel=1e-4, abs=1e-3)

    def test_exponentials_are_of_units_and_not_of_contexts(self, monkeypatch):
        """Each unit at each place before a token has its exponentials once, however many contexts it is in."""
        rng, n = np.random.default_rng(15), 300
        model = lm.LogBilinear.start(rng.integers(1, 50, n).astype(float))
        model.position[:] = rng.normal(1, 0.2, model.position.shape)
        contexts, targets = rng.integers(0, 40, (3000, 2)), rng.integers(0, n, 3000)
        # The last vectors are so long that no float holds the exponentials.
        for longest in (1, 400):
            model.context[35:] *= longest
            logits = sum(model.context[contexts[:, i]].astype(float) * model.position[i] for i in range(2)) @ model.output.T + model.bias
            plain = (logits[np.arange(3000), targets] - np.logaddexp.reduce(logits, axis=1)) / np.log(10)
            taken, exp = [], np.exp
            monkeypatch.setattr(np, "exp", lambda x, taken=taken, exp=exp, **to: taken.append(np.size(x)) or exp(x, **to))
            found = model.log10_classes(targets, contexts)
            monkeypatch.undo()
            assert found == pytest.approx(plain, rel=1e-4, abs=1e-3)
            assert longest > 1 or sum(taken) <= 2 * 40 * n

    def test_counts_of_partitions_are_summed(self, spark, monkeypatch):
        monkeypatch.setattr(lm, "SLICE", 50)
        monkeypatch.setattr(lm, "COUNT_WORDS", 7)
        texts = ["a b c", "", "a a \u00e9", None, "d e f g h i j k l m n o", "A B"] * 5
        plain = collections.Counter(w for t in texts for w in [*(t or "").encode().lower().split(), b""])
        rows = spark.createDataFrame([(t,) for t in texts], "__text string").coalesce(1)
        assert {bytes(r.word): r.c for r in lm.token_counts(rows).collect()} == plain

    def test_empty(self, empty, edges):
        assert lm.score_texts(empty, F.lit(False)).count() == 0
        assert lm.score_texts(edges, F.lit(True)).count() == len(EDGES)


def test_joining_pairs_span_all_similar_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 40, 120)
    sets = [np.unique(np.r_[rng.choice(base, int(rng.integers(90, 120)), replace=False), rng.integers(0, 1 << 40, int(rng.integers(0, 12)))]) for _ in range(400)]
    comps, fps = np.arange(400) // 2, np.zeros(400, np.uint64)

    def joined(pairs):
        label = comps.copy()
        for a, b in pairs:
            label[label == label[b]] = label[a]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}

    every = []
    for a in range(400):
        for b in range(a + 1, 400):
            shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                every.append((a, b))
    found = list(zip(*simhash_similar.joining_pairs(fps, comps, sets, 0.8, 24), strict=True))
    assert 0 < len(found) < 400 < len(every) and set(found) <= set(every)
    assert joined(found) == joined(every)
