"""The operators that learn from labels: held-out accuracy, exact search, gradients, edge cases; and the pipeline."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from peergraph.llm import labelled, quality, queries, toxicity

DATA = "/root/testdata/sf0.01"


def held_out(spark, found, label):
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in found.collect() if r.held_out and r.doc_id in known]
    return np.array([r.score for r in rows]), np.array([known[r.doc_id] for r in rows])


def auc(score, y):
    a, b = score[y == 1], score[y == 0]
    return float(((a[:, None] > b) + 0.5 * (a[:, None] == b)).mean())


def test_toxicity_held_out(spark):
    score, y = held_out(spark, queries.op7_toxicity(spark, DATA), "toxic")
    assert auc(score, y) > 0.85
    assert ((score >= 0.7) & (y == 0)).mean() < 0.02


def test_quality_held_out(spark):
    score, y = held_out(spark, queries.op9_quality(spark, DATA), "quality")
    assert auc(score, y) > 0.95
    assert (score[y == 1] >= 0.3).mean() > 0.97


def test_all_telling_words_are_features():
    telling = ["".join(chr(97 + k // 26**p % 26) for p in range(2)) for k in range(400)]
    texts = [" ".join(telling)] * 20 + ["zz common"] * 20
    assert set(telling) <= set(toxicity.choose_terms(texts, np.repeat([1, 0], 20)))


def test_block_max_search_is_exact(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.random((600, 20)) * (rng.random((600, 20)) < 0.2)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    index = toxicity.Index([(np.flatnonzero(v), v[v > 0]) for v in vectors], 20, list(range(600)), rng.integers(0, 2, 600))
    for _ in range(50):
        terms = np.sort(rng.choice(20, 4, replace=False))
        weights = rng.random(4)
        weights /= np.linalg.norm(weights)
        where, cosine = index.nearest(terms, weights, 10)
        best = np.sort(vectors[:, terms] @ weights)[::-1][:10]
        assert cosine == pytest.approx(best[best > 0])
        assert [float(vectors[index.ids[i], terms] @ weights) for i in where] == pytest.approx(cosine.tolist())


def test_toxicity_by_brute_force(spark):
    """Cosines of the evidence: every example against every document, over plain dictionaries."""
    documents = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    distinct = sorted({(texts[i], toxic[i]) for i in toxic if i in texts})
    terms = set(toxicity.choose_terms([t for t, _ in distinct], np.array([y for _, y in distinct])))
    counts = {i: Counter(f for w in toxicity.words(t) for f in toxicity.features(w) if f in terms) for i, t in texts.items()}
    df = Counter(f for c in counts.values() for f in c)

    def vector(c):
        v = {f: (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + df[f])) + 1) for f, n in c.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {f: x / norm for f, x in v.items()}

    examples = {(texts[i], toxic[i]): vector(counts[i]) for i in toxic if i in texts}
    found = queries.op7_toxicity(spark, DATA).collect()
    assert Counter(r.doc_id for r in found) == Counter(texts.keys())
    for r in found:
        own = vector(counts[r.doc_id])
        best = sorted((c for e in examples.values() if (c := sum(x * e.get(f, 0) for f, x in own.items())) > 0), reverse=True)[:3]
        assert [float(e.split(":")[1]) for e in r.evidence.split(",") if e] == pytest.approx(best, abs=0.00051)


def test_gradient_of_the_network():
    rng = np.random.default_rng(4)
    x, at, y = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    net = quality.Network(x, hidden=3)

    def loss():
        got = net.forward(x, at)[0]
        return -(y * np.log(got) + (1 - y) * np.log(1 - got)).mean()

    got, state = net.forward(x, at)
    for name, g in net.gradient(got, y, state).items():
        for place in np.ndindex(net.p[name].shape):
            net.p[name][place] += 1e-6
            up = loss()
            net.p[name][place] -= 2e-6
            down = loss()
            net.p[name][place] += 1e-6
            assert g[place] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_the_sample_is_bounded_by_whole_documents(spark):
    rows = spark.createDataFrame([(i, ("good words " if i % 2 else "b4d!! ") * 200) for i in range(20)], "doc_id long, text string")
    labels = rows.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
    assert quality.fit(rows, labels, F.lit(True), most=0) == 0.5
    score = {r.doc_id: r.score for r in quality.score(rows, quality.fit(rows, labels, F.lit(True), most=60)).collect()}
    assert min(score[i] for i in range(1, 20, 2)) > max(score[i] for i in range(0, 20, 2))
    x, at = quality.encode([b"a b" * 3_000_000])
    assert at.tolist() == [0, len(x)] and len(x) == -(-9_000_000 // quality.PASSAGE)


def test_attention_sums_to_one():
    x, at = quality.encode([b"", b"abc " * 400, b"x"])
    assert at.tolist() == [0, 1, 5, 6]
    _, state = quality.Network(x).forward(x, at)
    assert np.add.reduceat(state["attention"], at[:-1]) == pytest.approx(1)


def test_isotonic():
    x, v = labelled.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert np.interp([1, 2, 3, 4], x, v).tolist() == [0, 0.5, 0.5, 1]


def scored(module, rows, labels, label):
    if module is toxicity:
        return toxicity.score(rows, labels, F.lit(True), label)
    return quality.score(rows, quality.fit(rows, labels, F.lit(True), label))


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edge_cases(spark, module):
    label = "toxic" if module is toxicity else "quality"
    rows = spark.createDataFrame([(1, "fine words"), (1, "fine words"), (2, None), (None, ""), (3, "bad " * 5000)], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("terms", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (3, 1), (9, 1), (2, None)], f"doc_id long, {label} int")
    found = scored(module, rows, labels, label).collect()
    assert len(found) == 5
    assert all(0 <= r.score <= 1 and r.terms == "clash" for r in found)
    for only, want in ((labels.where(f"{label} = 1"), 1.0), (labels.limit(0), 0.0 if module is toxicity else 0.5)):
        assert {r.score for r in scored(module, rows, only, label).collect()} == {want}
    assert scored(module, rows.limit(0), labels, label).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "/root/testdata/sf0.001").checkpoint()
        if k < 4:
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").count() == 0
            kept.append(docs.count())
    assert kept[0] >= kept[1] == kept[2] == kept[3] > 0
    assert docs.select("doc_id").distinct().count() == kept[3]


def test_pipeline_runs(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    text, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(40_000))
    rows = [(1, text), (1, text), (None, text + " end"), (2, None), (3, ""), (None, "token = abcdefgh12345"), (4, "token = abcdefgh12345 once more"), (4, "another text of this id"), (5, other)]
    names = ("score", "kept", "own", "text_hash", "root", "key", "label", "row", "links", "n_bytes")
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(i, t, None, len(t or ""), *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(rows)], schema)
    labels = spark.createDataFrame([(1, None, 0), (1, 1, 0), (None, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    for name, (d, made) in {"odd": (docs, labels), "empty": (docs.limit(0), labels.limit(0))}.items():
        folder = str(tmp_path / name)
        d.write.parquet(f"{folder}/documents.parquet")
        made.write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder).checkpoint()
            assert now.dtypes == docs.dtypes
        found = {(r.doc_id, r.text or ""): r for r in now.collect()}
        packed = corpus_pipeline.STAGES[-1][1](spark, now, folder).collect()
        if name == "empty":
            assert not found and not packed
            continue
        assert set(found) == {(1, text), (2, ""), (None, "[SECRET]"), (4, "[SECRET] once more"), (4, "another text of this id"), (5, other)}
        for r in found.values():
            assert len({r[n].removeprefix(n) for n in names}) == 1
            assert r.n_chars == (None if r.text is None else len(r.text))
        assert sorted((r.doc_id, r.length) for r in packed if r.doc_id == 2) == [(2, 1)]
        assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
