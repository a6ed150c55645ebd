"""The registered queries and the pipeline as wholes: folds, result columns, odd ids, shuffled and empty input."""

import collections
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import common, exact_dedup, language, line_dedup, lm, quality, queries, samples, simhash_similar, token_files, toxicity

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
}


def words(rng, n, of=400, letter="w"):
    return " ".join(f"{letter}{rng.randrange(of)}" for _ in range(n))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def crc(doc, n):
    return zlib.crc32(str("" if doc is None else doc).encode()) % n


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with null and repeated ids, copies, benchmark passages and shared lines; ids from 0."""
    rng, out = random.Random(21), tmp_path_factory.mktemp("tables")
    item = prose(rng, 25)
    docs = [[i, prose(rng, 60) + (" vile scum" if i % 5 == 0 else "") if i % 4 else "spam 99 $$$ !!! " * 30, "xx" if i % 3 else None] for i in range(240)]
    for i in (1, 2, 3):
        docs[i][1] = docs[5][1] + " ."
    docs[7][1] = f"{docs[7][1]} {item} {docs[9][1]}"
    for i in (11, 13, 14):
        docs[i][1] += "\nthis line of more than ten words stands in several of the documents here"
    docs += [[None, prose(rng, 50), "xx"], [None, f"{prose(rng, 40)} {item}", "xx"], [None, None, None], [17, docs[17][1], "xx"], [18, prose(rng, 70), "yy"], [300, "", "xx"], [301, None, "xx"]]
    rows = {
        "documents": [(d, t, lang, "web", len(t or "")) for d, t, lang in docs],
        "labels": [(i, int(i % 4 > 0), int(i % 5 == 0 and i % 4 > 0)) for i in range(240)] + [(None, 1, 1), (3, None, None), (21, 0, 1)],
        "benchmark": [(1, item), (2, None)],
    }
    for name, table in rows.items():
        spark.createDataFrame(table, SCHEMAS[name]).coalesce(2).write.parquet(f"{out}/{name}.parquet")
    return str(out), rows


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("nothing")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{out}/{name}.parquet")
    return str(out)


COLUMNS = {
    "op1_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_returns_a_row_for_each_document(spark, folder, nothing, name):
    path, rows = folder
    df = queries.QUERIES[name](spark, path)
    assert ", ".join(" ".join(x) for x in df.dtypes) == COLUMNS[name]
    found = df.collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(r[0] for r in rows["documents"])
    fold = {"op5_language_id": (3, 1), "op6_toxicity": (5, 0), "op7_quality": (3, 1), "op10_lm_scoring": (7, 2)}.get(name)
    if fold:
        assert all(r.held_out == (crc(r.doc_id, fold[0]) == fold[1]) for r in found)
    if name in ("op6_toxicity", "op7_quality"):
        assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found)
        at = 2 if name == "op6_toxicity" else 1
        of = {r[0]: r[at] for r in rows["labels"] if r[0] is not None and r[0] not in (3, 21)}
        wrong = [r for r in found if r.held_out and r.doc_id in of and r.doc_id > 20 and r.predicted != of[r.doc_id]]
        assert len(wrong) <= 1
    assert queries.QUERIES[name](spark, nothing).count() == 0


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ids_of_other_types(spark, folder, kind):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast(kind))
    plain = spark.read.parquet(f"{folder[0]}/documents.parquet")
    found = token_files.token_file_index(docs, queries.WORD_BPE, 1)
    assert found.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert found.agg(F.sum("n_tokens")).first() == token_files.token_file_index(plain, queries.WORD_BPE, 1).agg(F.sum("n_tokens")).first()
    assert lm.score_texts(docs, F.lit(False)).schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    for df in (exact_dedup.exact_dedup(docs), simhash_similar.near_dedup(docs), language.predict(docs, language.fit(docs))):
        assert df.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and df.count() == docs.count()


def test_token_files_with_one_id_for_many_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None, words(rng, 5)) for _ in range(40)] + [(1, words(rng, 5)) for _ in range(40)]
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), queries.WORD_BPE, folder, 1, partitions=8)
    assert manifest.count() > 4  # dealt by text, not by id alone
    found = token_files.read_token_files(manifest, folder).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None] * 40 + [1] * 40
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()


class TestSamples:
    def test_repeated_ids(self, spark):
        docs = spark.createDataFrame([(1, "a", "xx")] * 20 + [(1, "b", "yy"), (2, "c", "xx"), (None, "d", "xx"), (3, "e", None)], "doc_id long, text string, lang string")
        assert sorted(tuple(r) for r in samples.texts_per_group(docs, "lang", 10).collect()) == [("xx", "a"), ("xx", "c"), ("yy", "b")]
        labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (4, 1)], "doc_id long, toxic int")
        found = samples.texts_with_labels(docs, samples.labelled_ids(labels, "toxic", 10))
        assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "a"), (2, 0, "c")]

    def test_limit(self, spark):
        labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") < 500).cast("int").alias("y"))
        count = lambda limit: {r["__label"]: r["count"] for r in samples.labelled_ids(labels, "y", limit).groupBy("__label").count().collect()}
        small, large = count(100), count(2000)
        assert all(25 <= small[x] <= 75 for x in (0, 1)) and large[1] == 500 and 1400 <= large[0] <= 1600


def test_language_is_the_nearest_centroid(spark):
    rng = random.Random(5)
    of = {"xx": "abcdefg", "yy": "nopqrst", "zz": "abcnopx"}
    rows = [(i, prose(random.Random(i), 3) + " " + "".join(rng.choice(of[lang]) for _ in range(40)), lang) for i in range(90) for lang in [("xx", "yy", "zz")[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, per_language=20, centroids=2)
    for r in language.predict(docs, model).collect():
        counts = np.zeros(language.DIM)
        text = " " + "".join(c if c.isalpha() else " " for c in rows[r.doc_id][1].lower()) + " "
        while "  " in text:
            text = text.replace("  ", " ")
        for i in range(len(text) - 2):
            h = 0
            for k, factor in enumerate((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)):
                h = (h ^ ord(text[i + k])) * factor & 0xFFFFFFFF
                counts[h >> 19] += 1
        v = np.log1p(counts) * model.idf
        cosines = model.centroids @ (v / np.linalg.norm(v))
        assert model.langs[int(cosines.argmax())] == r.lang_pred and r.score == pytest.approx(cosines.max(), abs=1e-5)
        assert r.rejected == (cosines.max() < model.least[cosines.argmax()] - 1e-9) or abs(cosines.max() - model.least[cosines.argmax()]) < 1e-5


def test_toxicity_score_is_the_sum_of_weights_and_pairs(spark):
    index = {toxicity.term(w): i for i, w in enumerate(["vile", "group", "^longer", "other"])}
    rng = np.random.default_rng(4)
    model = toxicity.FactorizationMachine(-0.3, rng.normal(size=4), rng.normal(size=(4, 3)), index)
    texts = ["vile group", "Group longerword", "", None, "vile vile OTHER group", "unknown"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        rows = sorted({index[t] for w in (texts[r.doc_id] or "").lower().split() for t in toxicity.word_terms(w) if t in index})
        z = model.bias + sum(model.weights[i] for i in rows) + sum(model.factors[i] @ model.factors[j] for i in rows for j in rows if i < j)
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_score_is_the_distance_to_the_threshold(spark, folder):
    path, rows = folder
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    weights = model.weights.reshape(model.cuts.shape)
    for r in quality.score(docs.withColumn("__text", F.lit(1)), model).collect():
        x = quality.features(r.text or "")
        z = (((x[:, None] > model.cuts) * weights).sum() - model.threshold) / model.scale
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30)))) and r["__text"] == 1


def test_lm_scores_every_row_of_shuffled_input(spark):
    """At a size where partitions are coalesced after a shuffle."""
    rng = random.Random(8)
    rows = [(i, words(rng, 5 + i % 40, 3000)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16, "doc_id").repartition("doc_id")
    found = {r.doc_id: r for r in lm.score_texts(docs, F.col("doc_id") % 7 == 2, heavy=200).collect()}
    assert {d: r.n_tokens for d, r in found.items()} == {i: len(t.split()) + 1 for i, t in rows}
    assert all(r.held_out == (d % 7 == 2) and r.score < 0 for d, r in found.items())


def test_copies_with_passages_repeated_unevenly(spark):
    """Texts of two passages, each repeated more often in one text than in the other, have nearly the same shingles."""
    rng, rows = random.Random(12), []
    for i in range(40):
        a, b = words(rng, 60, 10**6), words(rng, 60, 10**6)
        rows += [(2 * i, f"{a} " * rng.randint(3, 30) + b), (2 * i + 1, f"{a} " + f"{b} " * rng.randint(3, 30))]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    linked = {i for i in range(40) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])}
    found = {r.doc_id: r.component_id for r in simhash_similar.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(linked) > 30 and {i for i in range(40) if found[2 * i] == found[2 * i + 1]} == linked


def test_pivots_lose_no_join():
    """Two groups of near copies that lie close to one another, and rows between them."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 40, (2, 100))
    b[:75] = a[:75]
    edited = lambda base, k: np.unique(np.r_[rng.choice(base, 100 - k, replace=False), rng.integers(0, 1 << 40, k)])
    sets = [edited(a, int(rng.integers(0, 8))) for _ in range(60)] + [edited(b, int(rng.integers(0, 8))) for _ in range(60)]
    sets += [np.unique(np.r_[a[:90], b[90:]]), np.unique(np.r_[a[:80], b[80:]]), np.zeros(0, np.int64)]
    comps = np.array([5] * 60 + [9] * 60 + [20, 21, 22])
    join = lambda pairs: _classes(comps, pairs)
    every = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9 and len(sets[i])]
    found = list(zip(*simhash_similar.joining_pairs(np.zeros(len(sets), np.uint64), comps, sets, 0.8, 24), strict=True))
    assert join(found) == join(every) and len(found) < 5
    # Rows of one side are left to other parts.
    sides = np.array([1] * 60 + [2] * 60 + [2, 2, 2])
    across = list(zip(*simhash_similar.joining_pairs(np.zeros(len(sets), np.uint64), comps, sets, 0.8, 24, sides), strict=True))
    assert all(sides[i] != sides[j] for i, j in across)


def _classes(comps, pairs):
    label = comps.copy()
    for a, b in pairs:
        label[label == label[b]] = label[a]
    return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}


def test_first_of_groups(spark):
    rng = random.Random(6)
    base, other = prose(rng, 80), prose(rng, 80)
    rows = [(5, base), (4, base + " x"), (4, base + " y"), (4, base + " x"), (None, base), (None, other), (9, None), (8, ""), (8, ""), (7, prose(rng, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__i": F.lit(1), "__h": F.lit(2), "node": F.lit(3)})
    for shard_rows in (4096, 2):
        found = simhash_similar.first_of_groups(df, shard_rows=shard_rows)
        assert found.columns == df.columns
        kept = [(r.doc_id, r.text) for r in found.collect()]
        assert len(kept) == 4 and kept.count((8, "")) == 1 and (None, other) in kept and (7, rows[-1][1]) in kept
        assert sum(d == 4 and t in (base + " x", base + " y") for d, t in kept) == 1
    assert simhash_similar.first_of_groups(df.limit(0)).count() == 0


class TestPipeline:
    def test_stages(self, spark, folder):
        """Each stage against what a plain version keeps of its own input."""
        path, rows = folder
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            before = docs.collect()
            docs = common.materialize(stage(spark, docs, path), "stage")
            after = docs.collect()
            if name == "quality":
                assert docs.columns == list(rows_of(SCHEMAS["documents"]))
                good = [r for r in before if r.doc_id is None or r.doc_id >= 240 or r.doc_id % 4]
                assert len(after) >= 0.97 * len([r for r in good if r.text]) and not [r for r in after if "$$$" in (r.text or "")]
            elif name == "line dedup":
                assert len(after) == len(before)
                assert sum("stands in several" in (r.text or "") for r in after) == 1
            elif name == "near dedup":
                expected = self.groups(before)
                assert len(after) == len(expected) and {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for g in expected for r in g}
                for group in expected:
                    first = min((r.doc_id for r in group if r.doc_id is not None), default=None)
                    assert sum((r.doc_id, r.text) in {(x.doc_id, x.text) for x in group} and r.doc_id == first for r in after) >= 1
            elif name == "decontamination":
                item = rows["benchmark"][0][1]
                assert sorted((r.doc_id or -1, r.text or "") for r in after) == sorted((r.doc_id or -1, r.text or "") for r in before if item not in (r.text or ""))
            else:
                assert sorted(r.doc_id or -1 for r in after) == sorted(r.doc_id or -1 for r in before) and docs.columns == ["doc_id", "n_tokens", "ids"]
        found = corpus_pipeline.run(spark, path).collect()
        assert sorted((r.doc_id or -1, r.ids) for r in found) == sorted((r.doc_id or -1, r.ids) for r in after)

    @staticmethod
    def groups(rows):
        texts = [(r.text or "").lower().split() for r in rows]
        sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in texts]
        label = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if texts[i] == texts[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                    old = label[i]
                    label = [label[j] if x == old else x for x in label]
        return [[r for r, x in zip(rows, label, strict=True) if x == y] for y in sorted(set(label))]

    def test_one_text_of_an_id_is_contaminated(self, spark, folder):
        path, rows = folder
        docs = spark.createDataFrame([(1, f"a {rows['benchmark'][0][1]} b", "x", "y", 1), (1, "clean text", "x", "y", 1)], SCHEMAS["documents"])
        assert [r.text for r in corpus_pipeline.drop_benchmark(spark, docs, path).collect()] == ["clean text"]

    def test_empty(self, spark, nothing):
        assert corpus_pipeline.run(spark, nothing).count() == 0


def rows_of(schema):
    return [x.split()[0] for x in schema.split(", ")]


class TestWorkFolder:
    class Session:
        """A session of a cluster that names no shared folder."""

        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)
            getCheckpointDir = staticmethod(lambda: None)

    def test_a_cluster_needs_a_shared_folder(self):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.work_dir(self.Session, "x")

    def test_scratch_goes_with_its_block(self, spark):
        with common.scratch(spark) as folder:
            assert common.materialize(spark.range(5), "x").count() == 5
            path = folder.removeprefix("file://")
            import os

            assert os.path.isdir(path)
        assert not os.path.exists(path) and not common.work_dir(spark, "x").startswith(folder)


def test_columns_of_any_name(spark, folder, tmp_path):
    """Stages of the pipeline return the columns they were given, whatever these are called."""
    out, _ = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    names = ["__n_lines", "__n_dropped", "score", "__score", "__row", "__text", "a.b", "doc", "words", "row"]
    odd = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    plain = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, odd = (common.materialize(stage(spark, x, out), "stage") for x in (plain, odd))
        assert odd.columns == [*docs.columns, *names]
        assert sorted(map(repr, odd.select(*docs.columns).collect())) == sorted(map(repr, plain.collect()))
    last = corpus_pipeline.STAGES[-1][1](spark, odd, out)
    assert last.count() == plain.count()
    scored = quality.score(docs.withColumn("Score", F.lit("x")), None)
    assert scored.columns == [*docs.columns, "score"] and scored.first().score == 1.0
    counted = line_dedup.line_dedup(docs.withColumn("__n_lines", F.lit(-1)).withColumn("a.b", F.lit(2)))
    assert counted.columns[-2:] == ["___n_lines", "__n_dropped"] and {r["__n_lines"] for r in counted.collect()} == {-1}
