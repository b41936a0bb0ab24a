import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import resample as R
from tidemark.llm import words as W
from tidemark.llm.resample import fit, keep_selected, kth_largest, resample


def corpus(spark, n=600):
    words = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        own = [words[(i * 7 + j * 13) % 60] for j in range(40)]
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            own[3::9] = ["venom", "spite", "venom", "bile", "spite"]
        if junk:
            own = [w + "###" for w in own]
        # every text is one of its kind: copies count as one example
        rows.append((i, " ".join([*own, f"own{i}"])))
        if i % 2:
            labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r.selected for r in resample(docs, labels).collect()}
    held = [i for i in range(600) if i % 2 == 0]
    clean = [i for i in held if i % 5 and i % 7]
    assert all(got[i] for i in clean)
    assert not any(got[i] for i in held if i not in clean)
    again = {r.doc_id: r.selected for r in resample(docs.repartition(5), labels).collect()}
    assert again == got


def test_copies_are_one_example(spark):
    docs, labels = corpus(spark)
    odd = docs.where("doc_id = 5")
    many = docs.union(spark.range(1000, 1400).crossJoin(odd.select("text")).select(F.col("id").alias("doc_id"), "text"))
    marks = labels.union(spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.lit(1), F.lit(1)))
    weights = lambda d, lab: {r.doc_id: r.log_weight for r in resample(d, lab).where("doc_id < 600").collect()}
    one, two = weights(docs, labels), weights(many, marks)
    clean = [i for i in range(600) if i % 5 and i % 7]
    assert all(abs(one[i] - two[i]) < 0.5 for i in clean)


def plain_model(rows, labels, buckets):
    """Counts, log ratios and weights by dictionaries: {id: (n_features, log weight)}."""
    grams = {i: set(R.features(next(W.blocks(pa.array([t]), W.LOWER)))[1].tolist()) for i, t in rows}
    classes = {i: R.TARGET if q and not x else R.TOXIC if q else R.LOW for i, q, x in labels}
    assert all(q or not x for _, q, x in labels)
    n0, n1, single = {}, {}, [{}, {}, {}]
    for i, own in grams.items():
        for g in own:
            n0[g % buckets] = n0.get(g % buckets, 0) + 1
            if classes.get(i) == R.TARGET:
                n1[g % buckets] = n1.get(g % buckets, 0) + 1
            if i in classes:
                single[classes[i]][g] = single[classes[i]].get(g, 0) + 1

    def z2(a, b, all_a, all_b):
        p = all_a / (all_a + all_b)
        return 2 * ((a * np.log(a / ((a + b) * p)) if a else 0) + (b * np.log(b / ((a + b) * (1 - p))) if b else 0))

    total = [sum(c.values()) for c in single]
    kinds = set().union(*single)
    raw, extra = {}, [{}, {}]
    for k, a in n0.items():
        b, p = n1.get(k, 0), (a + 0.5) / (sum(n0.values()) + 0.5 * buckets)
        if z2(b, a, sum(n1.values()), sum(n0.values())) >= R.RAW_Z**2:
            raw[k] = np.log(p) - np.log((b + R.RAW_PRIOR * p) / (sum(n1.values()) + R.RAW_PRIOR))
    for g in kinds:
        base = R.PRIOR * (sum(c.get(g, 0) for c in single) + 0.5) / (sum(total) + 0.5 * len(kinds))
        target = np.log((single[0].get(g, 0) + base) / (total[0] + R.PRIOR))
        for k in (R.LOW, R.TOXIC):
            x = single[k].get(g, 0)
            if z2(x, single[0].get(g, 0), total[k], total[0]) >= R.Z**2:
                extra[k - 1][g] = np.log((x + base) / (total[k] + R.PRIOR)) - target
    n = np.array([sum(c == k for c in classes.values()) + 1.0 for k in range(3)])
    prior = np.log(n / n.sum())
    out = {}
    for i, own in grams.items():
        parts = [prior[0] + sum(raw.get(g % buckets, 0.0) for g in own)] + [prior[k] + sum(extra[k - 1].get(g, 0.0) for g in own) for k in (1, 2)]
        out[i] = (len(own), -np.logaddexp.reduce(parts))
    return out, (len(raw), len(extra[0]), len(extra[1]))


def test_counts_weights_and_draw_match_brute_force(spark):
    docs, labels = corpus(spark)
    rows, marks = [tuple(r) for r in docs.collect()], [(r.doc_id, r.quality, 0 if r.quality == 0 else r.toxic) for r in labels.collect()]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model, scored = fit(docs, labels)
    want, sizes = plain_model(rows, marks, model.buckets)
    assert min(sizes[1:]) > 2 and len(model.keys) >= sizes[0]
    got = {r.id: r for r in scored.collect()}
    assert all(got[i].n_features == n and abs(got[i].log_weight - w) < 1e-3 for i, (n, w) in want.items())
    # the draw: the k largest keys, k being the documents at or above a floor
    chosen = {r.doc_id for r in resample(docs, labels).where("selected").collect()}
    keys = sorted((r.sample_key for r in got.values()), reverse=True)
    assert chosen == {i for i, r in got.items() if r.sample_key >= keys[len(chosen) - 1]}
    assert {r.doc_id for r in keep_selected(docs.withColumn("log_weight", F.lit("x")), labels).collect()} == chosen


def test_raw_text_of_a_kind_without_labels_is_weighed_down(spark):
    docs, labels = corpus(spark, 3000)
    spam = spark.range(10_000, 11_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("buy now cheap pills online best price order today "), "id").alias("text"))
    got = {r.doc_id: r.log_weight for r in resample(docs.union(spam), labels).collect()}
    clean = [i for i in range(3000) if i % 5 and i % 7]
    assert max(w for i, w in got.items() if i >= 10_000) < np.percentile([got[i] for i in clean], 1)


def test_kth_largest(spark):
    df = spark.createDataFrame([(float(i % 50),) for i in range(500)], "x double")
    values = sorted((i % 50 for i in range(500)), reverse=True)
    assert [kth_largest(df, "x", k, bins=7) for k in (1, 77, 250, 500)] == [values[k - 1] for k in (1, 77, 250, 500)]


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (4, "c", 0), (4, "c", 0), (5, "é " * 40000, 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(4, None, None), (4, 1, None), (None, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    got = resample(docs, labels).collect()
    assert len(got) == 6 and not any(r.selected for r in got if r.doc_id in (1, 2))
    none = resample(docs, labels.where(F.lit(False))).collect()
    assert all(r.selected == (r.doc_id not in (1, 2)) for r in none)
    assert resample(docs.where(F.lit(False)), labels).count() == 0
