"""The pipeline's stages, one by one against brute force, and as a whole."""

import collections

import numpy as np

import corpus_pipeline
from clausula.llm import queries, secrets, toxicity


def five(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, after = docs, stage(spark, docs, small).cache()
        kept[name] = after
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns, name
        rows = {r.doc_id: r for r in before.collect()}
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity(before, spark.read.parquet(f"{small}/labels.parquet")).collect() if r.predicted}
            assert {r.doc_id for r in after.collect()} == set(rows) - bad
        elif name == "exact dedup":
            best = {}
            for i, r in rows.items():
                k = bytes(b for b in r.text.encode() if b not in b" \t\n\x0b\x0c\r")
                best[k] = max(best.get(k, (0, -(1 << 60))), (len(r.text), -i))
            assert {r.doc_id for r in after.collect()} == {-i for _, i in best.values()}
        elif name == "MinHash near-dedup":
            sets = {i: five(r.text) for i, r in rows.items()}
            root = {i: i for i in rows}

            def find(a):
                while root[a] != a:
                    a = root[a]
                return a

            for i in rows:
                for j in rows:
                    n = len(sets[i] & sets[j])
                    if j < i and n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
            assert {r.doc_id for r in after.collect()} == {i for i in rows if find(i) == i}
        elif name == "secret scans":
            found = {r.doc_id: r.spans for r in secrets.secrets(before).collect()}
            for r in after.collect():
                text = rows[r.doc_id].text
                assert (r.text == text) == (not found[r.doc_id]) and r.n_chars == (len(r.text) if found[r.doc_id] else rows[r.doc_id].n_chars)
            assert after.count() == len(rows)
        docs = after
    packed = docs.collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept["secret scans"].collect()}
    bins = collections.Counter()
    for r in packed:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and len(bins) <= np.ceil(sum(bins.values()) / 2048) + 1


def test_run_is_its_stages(spark, small):
    assert "pipeline" not in queries.queries()
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_odd_and_empty_tables(spark, small, odd, empty):
    for df in (odd, empty):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small).cache()
        assert (docs.count() > 0) == (df is odd)
